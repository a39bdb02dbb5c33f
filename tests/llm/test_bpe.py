import hashlib
import itertools
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def merged(word, rules):
    """The plain way: the first rule that applies, leftmost first, until none does."""
    rank = {(u, v): (i, uv) for i, (u, v, uv) in enumerate(rules)}
    seq = list(word)
    while True:
        best = min((rank[p][0] for p in itertools.pairwise(seq) if p in rank), default=None)
        if best is None:
            return seq
        u, v, uv = rules[best]
        out, i = [], 0
        while i < len(seq):
            if seq[i : i + 2] == [u, v]:
                out.append(uv)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq = out


def gadgets(rules, letters):
    """The automaton written out: for each rule, arcs uv are added and the states behind u are forked without v."""
    arcs = {0: dict.fromkeys(letters, 0)}
    for u, v, uv in rules:
        behind = {s: q for s in arcs if (q := arcs[s].get(u)) is not None and v in arcs[q]}
        target = {s: arcs[q][v] for s, q in behind.items()}
        for s, r in target.items():
            arcs[s][uv] = r
        forks = {q: max(arcs) + 1 + i for i, q in enumerate(sorted(set(behind.values())))}
        for q, copy in forks.items():
            arcs[copy] = {t: r for t, r in arcs[q].items() if t != v}
        for out in arcs.values():
            if out.get(u) in forks:
                out[u] = forks[out[u]]
    return arcs


def random_rules(seed, n=12):
    r = random.Random(seed)
    labels = {i: bytes([97 + i]) for i in range(3)}
    rules = []
    while len(rules) < n:
        u, v = r.choice(list(labels)), r.choice(list(labels))
        label = labels[u] + labels[v]
        if label not in labels.values() and len(label) < 9:
            labels[len(labels)] = label
            rules.append((u, v, len(labels) - 1))
    return labels, rules


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_merging(seed):
    labels, rules = random_rules(seed)
    a = bpe.Automaton(labels, rules)
    for n in range(1, 8):
        for word in itertools.product(range(3), repeat=n):
            assert a.encode(bytes(97 + x for x in word)) == merged(word, rules), (rules, word)


@pytest.mark.parametrize("seed", range(10))
def test_compiled_arcs_equal_gadgets_written_out(seed):
    labels, rules = random_rules(seed, 8)
    a, arcs = bpe.Automaton(labels, rules), gadgets(rules, range(3))
    for n in range(1, 7):
        for word in itertools.product(range(3), repeat=n):
            seq, state = a.encode(bytes(97 + x for x in word)), 0
            for t in seq:
                assert t in arcs[state], (rules, word, seq)
                state = arcs[state][t]


TEXTS = [None, "", " ", "  two  spaces \n\n x", "It's Über-naïve 東京 12345!\t\n", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x\t \ny  \n z ", "'S 've 'll''t", "z" * 5000, "  　 a", "é \U0001f600\U0001f468‍\U0001f469", "\x00\x1c\x85 \x1d a"]


def test_equals_the_library_and_decodes(spark):
    t = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, x, "k") for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string")
    encoded = bpe.encode(docs, PATH)
    got = {r.did: list(r.ids) for r in encoded.collect()}
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    assert got == want
    assert {r.did: r.text for r in bpe.decode(encoded, PATH).collect()} == {i: x or "" for i, x in enumerate(TEXTS)}
    for r in bpe.decode(encoded, PATH, digest=True).collect():
        assert r.n_tokens == len(want[r.did])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.did])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(want[r.did], skip_special_tokens=False).encode()).hexdigest()
        assert r.rest.ids == "k"


def test_broken_ids_decode_like_the_library(spark):
    t, r = Tokenizer.from_file(PATH), random.Random(4)
    rows = [(i, [r.randrange(50257) for _ in range(20)]) for i in range(50)]
    got = {x.did: x.text for x in bpe.decode(spark.createDataFrame(rows, "did long, ids array<int>"), PATH).collect()}
    assert got == {i: t.decode(ids, skip_special_tokens=False) for i, ids in rows}


def test_empty(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH), PATH, digest=True).count() == 0
