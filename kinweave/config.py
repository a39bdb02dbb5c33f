"""Knobs of a linkage run. What must be equal at training and use is the contract, and is stored with results."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

CONTRACT = ("k_key", "k_dense", "k_dense_script", "name_topk", "addr_topk", "num_topk", "max_df_pair", "max_df_name", "max_pairs_per_key", "bm25_k", "bm25_k_empty", "dense", "dense_adaptive", "k_dense_easy", "k_dense_empty", "feat_fuzz_brank_max")


@dataclass(frozen=True)
class Config:
    k_key: int = 40
    k_dense: int = 15
    k_dense_script: int = 50
    name_topk: int = 2
    addr_topk: int = 4
    num_topk: int = 2
    max_df_pair: int = 500
    max_df_name: int = 200
    max_pairs_per_key: int = 50_000
    bm25_k: int = 5
    bm25_k_empty: int = 40
    bm25_df_ratio: float = 0.20
    bm25_df_floor: int = 50
    dense: bool = True
    dense_adaptive: bool = False
    k_dense_easy: int = 5
    k_dense_empty: int = 30
    feat_fuzz_brank_max: int = 24
    stage1_folds: tuple[int, ...] = (0, 1, 2)
    stage2_folds: tuple[int, ...] = (3, 4, 5, 6, 7)
    holdout_folds: tuple[int, ...] = (8, 9)
    rounds: int = 40
    learning_rate: float = 0.1
    tree_depth: int = 5
    min_leaf: int = 20
    max_train_rows: int = 30_000_000
    dev_frac: float = 1.0
    train_countries: tuple[str, ...] = ()
    decision: str = "auto"
    housenum_boost: float = 0.05
    housenum_pen: float = 0.05
    seed: int = 42

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})

    def contract(self) -> dict:
        return {k: getattr(self, k) for k in CONTRACT}

    def key(self) -> str:
        """Names the folder of a stage's results, so changed knobs never meet stale ones."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:12]


def enforce_contract(trained: Config, used: Config) -> None:
    wrong = {k: (v, used.contract()[k]) for k, v in trained.contract().items() if v != used.contract()[k]}
    if wrong:
        raise ValueError(f"knobs differ from training: {wrong}")
