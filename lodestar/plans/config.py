"""Options of an experiment: from arguments, or from a file with an argument a line."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

METHODS = (
    "flat-scalar", "flat", "sq", "sq-int8", "pq", "ivf", "ivfpq-global", "ivfpq-global-opq", "ivfpq-local", "ivfpq-local-opq",
    "hnsw", "mpi-ivfpq", "mpi-ivf-hnsw", "mpi-random-hnsw", "mpi-kmeans-hnsw", "mpi-hoh",
)


@dataclass(frozen=True)
class Config:
    method: str = "flat"
    parallel: str = "none"
    data_dir: str = "./data"
    base_file: str = "DEEP100K.base.100k.fbin"
    query_file: str = "DEEP100K.query.fbin"
    ground_truth_file: str = "DEEP100K.gt.query.100k.top100.bin"
    output: str = ""
    split: str = "cyclic"
    queries: int = 2000
    k: int = 10
    threads: int = 1
    nlist: int = 100
    nprobe: int = 16
    m: int = 16
    ks: int = 256
    train_size: int = 10_000
    kmeans_iters: int = 6
    opq_iters: int = 2
    rerank_p: int = 200
    local_p: int = 50
    hnsw_m: int = 16
    ef_construction: int = 150
    ef_search: int = 64
    hnsw_layout: str = "original"
    gorder_window: int = 5
    porder_profile_queries: int = 200
    warmup_queries: int = 100
    evaluation_query_offset: int = 0
    route_p: int = 4
    seed: int = 2026
    dry_run: bool = False

    def checked(self) -> Config:
        """Itself, or ``ValueError`` for a value outside its domain."""
        one_of = lambda name, *allowed: (getattr(self, name) in allowed, f"{name.replace('_', '-')} must be one of {', '.join(allowed)}")
        rules = [
            (self.k > 0 and self.queries > 0, "k and queries must be positive"),
            (self.threads >= 1, "threads must be positive"),
            one_of("parallel", "none", "query", "list"),
            one_of("split", "cyclic", "block"),
            one_of("hnsw_layout", "original", "rcm", "gorder", "porder"),
            one_of("method", *METHODS),
            (self.gorder_window > 0, "gorder-window must be positive"),
            (self.hnsw_layout != "porder" or self.porder_profile_queries > 0, "porder-profile-queries must be positive"),
            (self.hnsw_layout == "original" or self.method in ("hnsw", "mpi-hoh"), "another hnsw-layout than original needs the method hnsw or mpi-hoh"),
        ]
        for holds, message in rules:
            if not holds:
                raise ValueError(message)
        return self

    @property
    def rotation_rounds(self) -> int:
        return self.opq_iters if self.method.endswith("-opq") else 0

    @property
    def label(self) -> str:
        """The method as results name it: with its layout, if it has another than the original."""
        if self.method not in ("hnsw", "mpi-hoh") or self.hnsw_layout == "original":
            return self.method
        parts = [self.method, self.hnsw_layout]
        if self.hnsw_layout in ("gorder", "porder"):
            parts.append(f"w{self.gorder_window}")
        if self.hnsw_layout == "porder":
            parts.append(f"p{self.porder_profile_queries}")
        return "-".join(parts)


def usage() -> str:
    lines = ["Options (with their defaults):"]
    lines += [f"  --{f.name.replace('_', '-')} {f.default}" if f.type != "bool" else f"  --{f.name.replace('_', '-')}" for f in fields(Config)]
    return "\n".join(lines)


def parse(arguments: list[str]) -> Config:
    """Options from arguments; unknown ones, missing or unfit values raise ``ValueError``."""
    kinds = {"--" + f.name.replace("_", "-"): (f.name, f.type) for f in fields(Config)}
    got: dict = {}
    rest = iter(arguments)
    for option in rest:
        if option not in kinds:
            raise ValueError(f"unknown option: {option}")
        name, kind = kinds[option]
        if kind == "bool":
            got[name] = True
            continue
        value = next(rest, None)
        if value is None:
            raise ValueError(f"missing value for {option}")
        if kind == "int":
            if not value.isascii() or not value.isdigit():
                raise ValueError(f"invalid value for {option}: {value}")
            value = int(value)
        got[name] = value
    return Config(**got).checked()


def from_file(path: str) -> list[str]:
    """Arguments of a file: one a line, blank lines and those that begin with ``#`` left out. An output below ``files/``
    is taken to be below the home folder."""
    with open(path, encoding="utf-8") as f:
        tokens = [t for t in (line.strip() for line in f) if t and not t.startswith("#")]
    for i, t in enumerate(tokens[:-1]):
        if t == "--output" and tokens[i + 1].startswith("files/") and os.environ.get("HOME"):
            tokens[i + 1] = os.path.join(os.environ["HOME"], tokens[i + 1])
    return tokens
