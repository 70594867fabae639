"""URL filters by a bit-parallel wildcard automaton.

All glob rules are laid out one after another in the bits of a few 64-bit words (Shift-And). One step
for each byte of a canonical URL moves the states of all rules at once, for all URLs of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import text as tx

#: Between host, path and the rest of a canonical URL. They can't occur in UTF-8.
AFTER_HOST, AFTER_PATH = 0xFF, 0xFE


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with the given one."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The site rules of the default filter.
SITE_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Globs (* any run, ? one byte) over path and rest that block a URL which no site rule fits.
BLOCK_PATHS = ("*/login*", "*/cart*", "*.zip", "*.exe")
BLOCK_RESTS = ("*utm_source=feed*", "*sessionid=*")


def _symbols(glob: str) -> list[int | None]:
    """Bytes of a glob; None is a star, -1 one byte of any value."""
    return [{0x2A: None, 0x3F: -1}.get(b, b) for b in glob.encode()]


class GlobAutomaton:
    """Globs as symbol lists, packed into multiword masks."""

    def __init__(self, globs: Iterable[list[int | None]]):
        step: list[int | None] = []  # the byte that leads to each bit; -2 for a first state
        loops, self.first, self.last = [], [], []
        for glob in globs:
            self.first.append(len(step))
            step.append(-2)
            for symbol in glob:
                if symbol is None:
                    loops.append(len(step) - 1)
                else:
                    step.append(symbol)
            self.last.append(len(step) - 1)
        n = self.words = len(step) // 64 + 1
        self.enter = np.zeros((256, n), np.uint64)
        for bit, symbol in enumerate(step):
            if symbol != -2:
                self.enter[slice(None) if symbol == -1 else symbol, bit // 64] |= np.uint64(1 << bit % 64)
        self.start, self.stay = self._mask(self.first), self._mask(loops)

    def _mask(self, bits: Iterable[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for bit in bits:
            out[bit // 64] |= np.uint64(1 << bit % 64)
        return out

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """rows x globs: whether the glob fits the whole row."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begins, long = offsets[:-1][order], lengths[order]
        state = np.tile(self.start, (len(order), 1))
        for at in range(int(long[0]) if len(long) else 0):
            live = int(np.searchsorted(-long, -at, "left"))  # rows that have a byte here
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.enter[data[begins[:live] + at]]
            now &= self.stay
            now |= moved
        out = np.zeros((len(order), len(self.last)), bool)
        for k, bit in enumerate(self.last):
            out[order, k] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1) > 0
        return out


def _rest_of(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """Up to /, ? or # after the first ://, with A-Z lower-cased; empty where there is none."""
    host = F.regexp_extract(F.coalesce(_rest_of(url), F.lit("")), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ? or #; empty where there is none."""
    return F.regexp_extract(F.coalesce(_rest_of(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def tail_of(url: Column) -> Column:
    """From the path's end on: query and fragment."""
    return F.regexp_extract(F.coalesce(_rest_of(url), F.lit("")), "(?s)^[^/?#]*[^?#]*(.*)", 1)


def filter_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = SITE_RULES,
    block_paths: tuple[str, ...] = BLOCK_PATHS,
    block_rests: tuple[str, ...] = BLOCK_RESTS,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """key, host, path, rule and verdict of each URL.

    The longest fitting rule decides; else a URL is blocked if a glob fits, and allowed otherwise. A null
    URL, or one without ://, has an empty host and path, no rule, and is allowed. Rows with equal keys or
    URLs each get a row; an empty table gives an empty one; further columns are ignored.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [[None, 0x2E, *r.host.encode(), AFTER_HOST, *r.path.encode(), None] for r in ranked]
    globs += [[None, AFTER_HOST, *_symbols(g), AFTER_PATH, None] for g in block_paths]
    globs += [[None, AFTER_PATH, *_symbols(g)] for g in block_rests]
    automaton = GlobAutomaton(globs)
    names = pa.array([*(r.name for r in ranked), None], pa.string())
    verdicts = np.array([*(r.verdict for r in ranked), ""], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, tails = (batch.column(k).to_pylist() for k in (1, 2, 3))
            canonical = [b".%s\xff%s\xfe%s" % (h.encode(), p.encode(), t.encode()) for h, p, t in zip(hosts, paths, tails, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in canonical])]).astype(np.int64)
            found = automaton.matches(np.frombuffer(b"".join(canonical), np.uint8), offsets)
            k = len(ranked)
            which = np.where(found[:, :k].any(1), found[:, :k].argmax(1) if k else 0, k)
            own = np.where(found[:, k:].any(1), "block", "allow").astype(object)
            said = np.where(which < k, verdicts[which], own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), names.take(pa.array(which)), pa.array(said, pa.string())], ["key", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(key).cast("long").alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), tail_of(F.col(url)).alias("tail"))
    return tx.arrow_map(rows, judge, "key long, host string, path string, rule string, verdict string").withColumnRenamed("key", key)
