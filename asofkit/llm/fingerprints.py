"""Document fingerprints from prefix polynomial hashes.

A text's code points c_0, c_1, ... have, for each of two primes p, the prefix array

    S[0] = 0,  S[i + 1] = S[i] + (c_i + 1) * b**i  (mod p)

from which the hash of any span [i, j) is (S[j] - S[i]) * b**-i (mod p): equal spans have equal hashes
wherever they stand, and two unequal spans collide with a probability of about their length / 2**62. Binary
search over span hashes gives longest common extensions. A fingerprint holds the length, the hash of the whole
text and a one-permutation sketch of the hashes of all spans of SPAN code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import bounded_batches, partitions_for, releasing

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003_333 % PRIMES[0], 1_618_033_989 % PRIMES[1])
SPAN = 24
SLOTS = 128
_SLOT_BITS = 7
_VALUE_BITS = 12
_starts = np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - _SLOT_BITS)
_ends = _starts | np.uint64((1 << (64 - _SLOT_BITS)) - 1)


class _Powers:
    """b**i and b**-i modulo p for i below a length that grows on demand."""

    def __init__(self, base: int, prime: int):
        self.p, self.steps = prime, (base, pow(base, -1, prime))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> _Powers:
        while len(self.up) < n:
            m = len(self.up)
            ahead = [np.uint64(pow(b, m, self.p)) for b in self.steps]
            self.up, self.down = (np.concatenate([t, t * a % np.uint64(self.p)]) for t, a in zip((self.up, self.down), ahead))
        return self


_powers = tuple(_Powers(b, p) for b, p in zip(BASES, PRIMES))


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), "<u4")


def _prefix(points: np.ndarray, at: int = 0, start: tuple[int, int] = (0, 0)) -> list[np.ndarray]:
    """For each prime, S after each of *points*, which stand at *at*; *start* is S before them."""
    out = []
    for powers, s in zip(_powers, start):
        p = np.uint64(powers.p)
        terms = (points.astype(np.uint64) + np.uint64(1)) * powers.upto(at + len(points) + 1).up[at : at + len(points)] % p
        out.append((np.cumsum(terms, dtype=np.uint64) + np.uint64(s)) % p)
    return out


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, points: np.ndarray, arrays: list[np.ndarray] | None = None):
        self.n = len(points)
        self.points = points
        self.s = arrays or [np.concatenate([np.zeros(1, np.uint64), a]) for a in _prefix(points)]

    @classmethod
    def of(cls, text: str | None) -> PrefixHash:
        return cls(code_points(text))

    def spliced(self, keep: int, tail: np.ndarray) -> PrefixHash:
        """The first *keep* code points followed by *tail*; the arrays of what is kept are reused."""
        more = _prefix(tail, keep, tuple(int(a[keep]) for a in self.s))
        return PrefixHash(np.concatenate([self.points[:keep], tail]), [np.concatenate([a[: keep + 1], b]) for a, b in zip(self.s, more)])

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash of the code points from i up to, not including, j."""
        return tuple((int(a[j]) - int(a[i])) % w.p * int(w.upto(i + 1).down[i]) % w.p for a, w in zip(self.s, _powers))

    def spans(self, length: int) -> np.ndarray:
        """The hashes of all spans of that length, 62 bits each."""
        count = self.n - length + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        parts = []
        for a, w in zip(self.s, _powers):
            p = np.uint64(w.p)
            parts.append((a[length:] + p - a[:count]) % p * w.upto(count).down[:count] % p)
        return parts[0] << np.uint64(31) | parts[1]

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        return i + length <= self.n and j + length <= other.n and self.span(i, i + length) == other.span(j, j + length)

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """How many code points agree from i here and from j in *other*."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def sketch(text: PrefixHash) -> np.ndarray:
    """For each slot the low bits of the least mixed hash that falls there; an empty slot borrows from the next one."""
    if not text.n:
        return np.zeros(SLOTS, np.uint16)
    hashes = np.sort(_mixed(text.spans(min(SPAN, text.n))))
    first = np.searchsorted(hashes, _starts)
    low = hashes[np.minimum(first, len(hashes) - 1)]
    full = (first < len(hashes)) & (low <= _ends)
    own = np.flatnonzero(full)
    if len(own) == SLOTS:
        return (low & np.uint64((1 << _VALUE_BITS) - 1)).astype(np.uint16)
    lender = own[np.searchsorted(own, np.arange(SLOTS)) % len(own)]
    away = (lender - np.arange(SLOTS)) % SLOTS
    return (_mixed(low[lender] + np.uint64(0x9E3779B9) * away.astype(np.uint64) * (away > 0)) * (away > 0) + low[lender] * (away == 0) & np.uint64((1 << _VALUE_BITS) - 1)).astype(np.uint16)


def whole(text: PrefixHash) -> str:
    a, b = text.span(0, text.n)
    return f"{text.n:x}-{a << 31 | b:016x}"


_hex = np.array([f"{v:03x}" for v in range(1 << _VALUE_BITS)])


def fingerprint(text: PrefixHash) -> tuple[str, np.ndarray]:
    """The fingerprint, and the slots in it."""
    slots = sketch(text)
    return f"{whole(text)}-{''.join(_hex[slots])}", slots


def _alike(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> float:
    if a[0] == b[0]:
        return 1.0
    if a[0].startswith("0-") or b[0].startswith("0-"):
        return 0.0
    return float(np.count_nonzero(a[1] == b[1])) / SLOTS


def likeness(a: str, b: str) -> float:
    """The estimated share of equal spans (Jaccard) of two texts, from their fingerprints; 1 for equal ones, 0 if just one is empty."""
    slots = lambda f: np.array([int(f[-3 * SLOTS :][i : i + 3], 16) for i in range(0, 3 * SLOTS, 3)])
    return _alike((a, slots(a)), (b, slots(b)))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns part, extra, k, t: the documents of each range of keys in one task, ascending, and after them (extra) the first of the next range.

    After the last range follows the first document of all. Null keys come first; equal keys are ordered
    by text. Only range bounds and the first key of each range pass the driver: as many as there are ranges.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions_for(spark)
    docs = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    cuts = docs.select(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    numbered = docs.withColumn("d", F.col("k").cast("double"))
    if len(splits) > 2:
        numbered = Bucketizer(splits=splits, inputCol="d", outputCol="b", handleInvalid="keep").transform(numbered)
    else:
        numbered = numbered.withColumn("b", F.lit(0.0))
    numbered = numbered.select("k", "t", F.when(F.col("k").isNull(), 0).otherwise(F.col("b").cast("int")).alias("part"))
    heads = numbered.groupBy("part").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"), F.count("k").alias("nk")).orderBy("part").collect()
    first = [(r["part"], r["k"] if r["n"] == r["nk"] else None) for r in heads]  # a null key stands before all others
    before = [(k, first[i - 1][0]) for i, (_, k) in enumerate(first)]
    leads = spark.createDataFrame(before, "h bigint, to int")
    placed = numbered.join(F.broadcast(leads), F.col("k").eqNullSafe(F.col("h")), "left")
    stands = F.filter(F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.struct(F.col("to").alias("part"), F.lit(True).alias("extra"))), lambda x: x["part"].isNotNull())
    spread = placed.select("k", "t", F.explode(stands).alias("x")).select("x.part", "x.extra", "k", "t")
    return spread.repartitionById(max(n, len(splits) - 1), F.col("part")).sortWithinPartitions("part", "extra", F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first())


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last quarter gives way to the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Documents
    follow each other by key, null keys first, equal keys by text; after the last comes the first, which may be the
    document itself. A null text is empty. Rows that repeat a key are documents of their own. Other columns
    aren't read; an empty table gives an empty table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, done = None, None
        for batch in batches:
            rows = []
            for part, extra, k, t in zip(batch["part"], batch["extra"], batch["k"], batch["t"]):
                if extra and (last is None or last[0] != part or done == part):
                    continue
                here = PrefixHash.of(t)
                print_ = fingerprint(here)
                if last is not None and last[0] == part:
                    _, key_, prior, mark = last
                    cut = prior.n // 4
                    edited = prior.spliced(prior.n - cut, here.points[:cut]) if cut else prior
                    other = fingerprint(edited) if cut else mark
                    digest = hashlib.sha256(edited.points.tobytes().decode("utf-32-le").encode()).hexdigest()
                    rows.append((key_, prior.n, digest, mark[0], other[0], _alike(mark, other), _alike(mark, print_)))
                done = part if extra else done
                last = (part, k, here, print_)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
            out["doc_id"] = [None if v is None or pd.isna(v) else int(v) for v in out["doc_id"]]
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return with_next(docs, key, text).select("part", "extra", F.col("k").cast("string").alias("k"), "t").mapInPandas(releasing(run), OUT)
