"""The registered queries of this subpackage, one per operator."""

from .ann import op6_nearest_neighbours
from .bpe import op2_bpe
from .langid import op10_language_id
from .chat import ORACLE as CHAT_SQL
from .chat import op5_chat
from .decontaminate import op7_decontaminate
from .simhash import op1_simhash
from .warc import ORACLE as WARC_SQL
from .warc import op3_warc
from .suffix import op4_suffix_dedup
from .sstable import op9_token_tables
from .substring import ORACLE as SUBSTRING_SQL
from .substring import op8_substring_dedup

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat": op5_chat,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_decontaminate": op7_decontaminate,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_tables": op9_token_tables,
    "op10_language_id": op10_language_id,
}
ORACLE = {"op3_warc": WARC_SQL, "op5_chat": CHAT_SQL, "op8_substring_dedup": SUBSTRING_SQL}
