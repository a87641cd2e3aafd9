"""Exact set-similarity join of documents on word shingles, with skipping by set relations.

Sets that are equal become one node. Under one global order of shingles (rare ones by hash, then frequent ones by
document frequency) two sets with Jaccard similarity t or more share a shingle among the first n - ceil(t * n) + 1 of each:
their prefixes. The lists of nodes by prefix shingle are the index. Relations between sets spare comparisons:

* Answer level. Each list has a hub, its node with the largest share of shingles that others have as well, and all entries are compared with it first. Once o_x, the set that x
  shares with the hub, and r_x, the shingles of x beyond it, are known, the answers of x follow from the hub's: |x & z| = |o_x & o_z| + |r_x & r_z|. Lists
  whose entries are in one component by now are done. In others, x and z can only be similar if min(|o_x|, |o_z|) suffices by itself, or if they share one of the
  first few of the shingles beyond the hub, which are indexed in turn. o_x is kept as a bit for each shingle of the hub, so |o_x & o_z| is counted and not bounded, and
  r_x as a bit for each of 1,024 parts of the hashes: a part that x has and z has not is a shingle that they don't share.
* Index level. Entries of those lists stand at positions of their sets. A common shingle at positions i and j leaves room for min(i, j) + 1 + min(|r_x| - i - 1, |r_z| - j - 1)
  common ones, so blocks of entries of like positions and sizes whose bound falls short are skipped whole.

Short lists, most of which are there by chance and whose number grows faster than that of the documents, are spelled out as pairs. A bitmap of each set, two to four bits
for each shingle, bounds what two sets can share, and only texts of pairs that it leaves open are compared.

The shingles of frequent lists, those of large groups and of passages that many documents share, are handled as rows with partial aggregation; lists
of other shingles are short by definition and are handled in numpy, many to a block.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import bounded_batches, fresh, partitions_for, releasing, saved, small, tidy
from asofkit.llm.components import components
from asofkit.llm.tokens import span_hashes

WORDS = 5
#: The similarity in hundredths.
PERCENT = 75
#: A shingle in at least so many documents is frequent: its list is handled as rows.
FREQUENT = 256
#: Shingles in at least so many documents are ordered by frequency, after all others.
ORDERED_FROM = 4
#: The most frequent shingles whose frequencies take part in the order: 8 bytes each are broadcast.
ORDERED = 1_000_000
#: Lists of rare shingles with at most so many nodes are spelled out as pairs.
SHORT_LIST = 32
#: Bits of a shingle's hash by which frequencies are counted. Shingles that share them count together, which changes the order only.
KEY_BITS = 32
#: Entries of an open list that one task compares with as many others.
BLOCK = 2_048
BROADCAST_ROWS = 200_000
#: Ids of texts are told from others by a table of 2 ** FILTER_BITS bits (8 MB).
FILTER_BITS = 26
_COUNT_AT = 1_000_000
_GROUP = 100_000
#: Bytes of text whose shingles are counted in one group, and entries of rare lists that are gathered in one: the number of groups grows with the data.
COUNT_BYTES = 6 << 20
GATHER_ENTRIES = 500_000
_SKIP = 32
_PART_BITS = 10
_spaces = np.zeros(256, bool)
_spaces[[32, *range(9, 14)]] = True
_weights = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingle_sets(texts: list[str | None], at_once: int = 1_000_000) -> Iterator[np.ndarray]:
    """For each whole text the sorted hashes of its distinct shingles.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, with A-Z in lower case. A text of
    fewer than WORDS words has one shingle, the whole sequence; a text without words has none.
    """
    run, size = [], 0
    for t in texts:
        run.append((t or "").encode().lower())
        size += len(run[-1])
        if size > at_once:
            yield from _sets(run)
            run, size = [], 0
    yield from _sets(run)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    if not texts:
        return
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    blank = _spaces[data]
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        yield from (np.empty(0, np.uint64) for _ in texts)
        return
    a, b = span_hashes(data, start, end)
    word = _mixed(a ^ _mixed(b + (end - start).astype(np.uint64)))
    first = np.searchsorted(start, begins)
    full = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        full += word[k : k + len(full)] * _weights[k]
    full = _mixed(full)
    for i, j in zip(first[:-1], first[1:]):
        if j - i >= WORDS:
            yield np.unique(full[i : j - WORDS + 1])
        elif j > i:
            yield _mixed((word[i:j] * _weights[: j - i]).sum(dtype=np.uint64, keepdims=True) + np.uint64(j - i))
        else:
            yield np.empty(0, np.uint64)


def _least_common(n_x, n_y, percent: int):
    """The least intersection that makes sets of these sizes similar: 100 * o >= percent * (n_x + n_y - o)."""
    return -(-percent * (n_x + n_y) // (100 + percent))


def _band_width(percent: int) -> float:
    """Lists are cut by size: a node of band b goes to the lists of bands b and b + 1, so that two nodes of like sizes meet and others don't.

    Sizes of similar sets differ by the factor 100 / percent at most, and so by one band; the width is a trifle more, for logarithms are rounded.
    """
    return float(np.log(100 / min(percent, 99))) * (1 + 1e-9)


def _groups(total: int | None, each: int) -> int:
    """How many groups hold *total* if each takes *each*."""
    return max(1, -(-int(total or 0) // each))


def _node(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _short(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def _bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each value of the trailing bits of the hashes, set where a shingle has it: least power of two of 64 or more that is at least twice the number of shingles."""
    m = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(m, bool)
    bits[tokens & np.uint64(m - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(n_x: int, x: bytes, n_y: int, y: bytes) -> int:
    """No fewer than the shingles that two sets of these sizes and bitmaps share: a bit that one has alone is a shingle that the other lacks."""
    if len(x) > len(y):
        n_x, x, n_y, y = n_y, y, n_x, x
    a, b, m = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(y)
    while m > 8 * len(x):  # the halves of the longer one are laid over each other
        m //= 2
        b = (b | b >> m) & ((1 << m) - 1)
    return min(n_x - (a & ~b).bit_count(), n_y - (b & ~a).bit_count())


# ---------------------------------------------------------------- the global order


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys (leading bits) of shingles in several documents, ascending, and how many documents each has: the most frequent ones, no more than ORDERED."""
    import zstandard

    shift = np.uint64(64 - KEY_BITS)
    parts = _groups(docs.agg(F.sum(F.octet_length("t"))).first()[0], COUNT_BYTES)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def out() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            edges = (np.arange(parts, dtype=np.uint64) * np.uint64(1 << KEY_BITS) // np.uint64(parts)).astype(np.uint32)
            cut = np.append(np.searchsorted(keys, edges), len(keys))
            zip_ = zstandard.ZstdCompressor(level=1).compress
            rows = [(p, b - a, zip_(np.diff(keys[a:b], prepend=keys[a : a + 1]).reshape(-1, 1).view(np.uint8).T.tobytes()), int(keys[a]), zip_(n[a:b].astype(np.uint32).tobytes())) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            return pd.DataFrame(rows, columns=["part", "n", "steps", "first", "counts"])

        for batch in batches:
            for s in shingle_sets(batch["t"].tolist()):
                if len(s):
                    held.append((s >> shift).astype(np.uint32))
                    size += len(s)
                if size > _COUNT_AT:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def total(group: pd.DataFrame) -> pd.DataFrame:
        unzip = zstandard.ZstdDecompressor().decompress
        keys, counts = [], []
        for n, steps, first, c in zip(group["n"], group["steps"], group["first"], group["counts"]):
            d = np.frombuffer(unzip(steps), np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel()
            keys.append((np.cumsum(d, dtype=np.int64) + (first - int(d[0]))).astype(np.uint32))
            counts.append(np.frombuffer(unzip(c), np.uint32))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts, first, dtype=np.int64)
        often = sums >= ORDERED_FROM
        return pd.DataFrame({"keys": [keys[first][often].astype(np.uint32).tobytes()], "counts": [np.minimum(sums[often], 1 << 31).astype(np.uint32).tobytes()]})

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c in batch["counts"]:
                n, rows = np.unique(np.minimum(np.frombuffer(c, np.uint32), 1 << 16), return_counts=True)
                yield pd.DataFrame({"n": n.astype(np.int64), "rows": rows})

    blocks = docs.select("t").mapInPandas(releasing(count), "part int, n int, steps binary, first bigint, counts binary")
    found = saved(blocks.groupBy("part").applyInPandas(total, "keys binary, counts binary"), "frequent")
    # From which frequency on there are no more than ORDERED: a number of rows for each of 65,536 frequencies at most.
    tally = sorted(found.mapInPandas(releasing(sizes), "n bigint, rows bigint").groupBy("n").agg(F.sum("rows").alias("rows")).collect(), reverse=True)
    least, room = 1 << 17, ORDERED
    for n, rows in tally:
        if (room := room - rows) < 0:
            break
        least = n

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, c in zip(batch["keys"], batch["counts"]):
                keep = np.frombuffer(c, np.uint32) >= least
                yield pd.DataFrame({"keys": [np.frombuffer(k, np.uint32)[keep].tobytes()], "counts": [np.frombuffer(c, np.uint32)[keep].tobytes()]})

    got = found.mapInPandas(releasing(top), "keys binary, counts binary").collect()
    keys = np.concatenate([np.empty(0, np.uint32), *[np.frombuffer(r["keys"], np.uint32) for r in got]])
    counts = np.concatenate([np.empty(0, np.uint32), *[np.frombuffer(r["counts"], np.uint32) for r in got]])
    order = np.argsort(keys)
    return keys[order], counts[order]


# ---------------------------------------------------------------- nodes, prefixes and lists


def _nodes(docs: DataFrame, keys: np.ndarray, counts: np.ndarray, percent: int) -> DataFrame:
    """For each document: id, th (hash of the text), n, node, short (its first 8 bytes, least significant first), rare (rare prefix shingles), often (frequent ones), share (of shingles in several documents, in thousandths), bits (see _bitmap)."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = shared.value
        for batch in batches:
            rows = []
            for id_, th, s in zip(batch["id"], batch["th"], shingle_sets(batch["t"].tolist())):
                n = len(s)
                if not n:
                    rows.append((id_, th, 0, None, 0, None, None, 0, None))
                    continue
                reach = n - -(-percent * n // 100) + 1
                weight = _weights_of(s, keys, counts)
                prefix = np.lexsort((s, weight))[:reach]
                split = int(np.searchsorted(weight[prefix], FREQUENT))
                rows.append((id_, th, n, node := _node(s), _short(node), s[prefix[:split]].tobytes(), s[prefix[split:]].tobytes(), 1000 * int(np.count_nonzero(weight)) // n, _bitmap(s)))
            yield pd.DataFrame(rows, columns=["id", "th", "n", "node", "short", "rare", "often", "share", "bits"])

    return docs.select(F.col("id").cast("string").alias("id"), "t", F.xxhash64("t").alias("th")).mapInPandas(releasing(run), "id string, th bigint, n int, node binary, short bigint, rare binary, often binary, share int, bits binary").withColumn("id", F.col("id").cast("bigint"))


def _weights_of(tokens: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The frequencies by which shingles are ordered; 0 for those not in the table."""
    if not len(keys):
        return np.zeros(len(tokens), np.uint32)
    k = (tokens >> np.uint64(64 - KEY_BITS)).astype(np.uint32)
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    return np.where(keys[at] == k, counts[at], 0)


def _rare_lists(nodes: DataFrame, parts: int, percent: int) -> DataFrame:
    """list, nodes, sizes: distinct lists of two or more nodes that share a rare prefix shingle, the hub first."""
    width = _band_width(percent)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [np.frombuffer(b, np.uint64) for b in batch["rare"]]
            sizes = np.array([len(t) for t in tokens])
            if not len(sizes) or not sizes.sum():
                continue
            token = np.concatenate(tokens)
            node = np.repeat(np.array([_short(bytes(b)) for b in batch["node"]], np.int64), sizes)
            n, share = (np.repeat(batch[c].to_numpy(np.int32), sizes) for c in ("n", "share"))
            order = np.argsort(token)
            token, node, n, share = token[order], node[order], n[order], share[order]
            part = ((token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(part, np.arange(parts + 1))
            yield pd.DataFrame([(p, token[a:b].tobytes(), node[a:b].tobytes(), n[a:b].tobytes(), share[a:b].tobytes()) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a], columns=["part", "token", "node", "n", "share"])

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        col = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in group[c]])
        token = col("token", np.uint64)
        order = np.argsort(token)
        same = token[order[1:]] == token[order[:-1]]
        met = order[np.append(same, False) | np.append(False, same)]  # most shingles have one node only
        token, node, n, share = token[met], col("node", np.int64)[met], col("n", np.int32)[met], col("share", np.int32)[met]
        band = np.floor(np.log(n) / width).astype(np.int16)
        token, node, n, share, band = np.tile(token, 2), np.tile(node, 2), np.tile(n, 2), np.tile(share, 2), np.concatenate([band, band + 1])
        order = np.lexsort((node, -share, band, token))  # the hub comes first
        token, band = token[order], band[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(token)), bool), (token[1:] != token[:-1]) | (band[1:] != band[:-1])]))
        size = np.diff(np.append(first, len(token)))
        seen, rows = set(), []
        for a, m in zip(first[size > 1], size[size > 1]):
            at = order[a : a + m]
            if (mark := node[at].tobytes()) not in seen:
                seen.add(mark)
                rows.append((node[at], n[at]))
        return pd.DataFrame(rows, columns=["nodes", "sizes"])

    blocks = nodes.select("node", "n", "share", "rare").mapInPandas(releasing(spread), "part int, token binary, node binary, n binary, share binary")
    lists = blocks.groupBy("part").applyInPandas(gather, "nodes array<bigint>, sizes array<int>")
    return lists.withColumn("list", F.xxhash64("nodes")).dropDuplicates(["list"])


def _members(lists: DataFrame) -> DataFrame:
    """list, hub, node, n, more (whether the list has others than these two): a row for each node of *lists* (list, nodes, sizes) but the hub."""
    members = lists.select("list", F.get("nodes", F.lit(0)).alias("hub"), (F.size("nodes") > 2).alias("more"), F.explode(F.arrays_zip("nodes", "sizes")).alias("x"))
    return members.select("list", "hub", F.col("x.nodes").alias("node"), F.col("x.sizes").alias("n"), "more").filter("node <> hub")


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """a, b, star (whether one is the hub): the pairs of nodes of *lists* (list, nodes, sizes) whose sizes let them be similar."""
    at = lambda i: F.struct(F.get("nodes", i).alias("v"), F.get("sizes", i).alias("n"))
    ends = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda j: F.transform(F.sequence(F.lit(0), j - 1), lambda i: F.struct(at(i).alias("x"), at(j).alias("y"), (i == 0).alias("star"))))
    pairs = lists.select(F.explode(F.flatten(ends)).alias("p")).filter(100 * F.least("p.x.n", "p.y.n") >= percent * F.greatest("p.x.n", "p.y.n"))
    return pairs.select(F.least("p.x.v", "p.y.v").alias("a"), F.greatest("p.x.v", "p.y.v").alias("b"), "p.star")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b, star: those of *pairs*, once each, that the bitmaps of *nodes* (short, n, bits) let be similar."""
    side = lambda x: nodes.select(F.col("short").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    joined = pairs.groupBy("a", "b").agg(F.max("star").alias("star")).join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [most_common(m, x, n, y) >= _least_common(m, n, percent) for m, x, n, y in zip(batch["a_n"], batch["a_bits"], batch["b_n"], batch["b_bits"])]
            yield batch.loc[np.array(keep, bool), ["a", "b", "star"]]

    return joined.select("a", "b", "star", "a_n", "a_bits", "b_n", "b_bits").mapInPandas(releasing(run), "a bigint, b bigint, star boolean")


def _often_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """list, hub, node, n, more as of _members() for frequent prefix shingles; lists are told apart by sums over their members, never gathered."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, n, share, often in zip(batch["node"], batch["n"], batch["share"], batch["often"]):
                yield pd.DataFrame({"token": np.frombuffer(often, np.int64), "node": _short(bytes(node)), "n": n, "share": share})

    rows = saved(nodes.filter(F.octet_length("often") > 0).select("node", "n", "share", "often").mapInPandas(releasing(_batched(spread)), "token bigint, node bigint, n int, share int"), "often_rows")
    mark = F.xxhash64("node")
    band = F.floor(F.log("n") / _band_width(percent)).cast("int")
    rows = rows.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("token", F.xxhash64("token", "band")).drop("band")
    sums = rows.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum(mark % 1_000_000_007).alias("a"), F.bit_xor(mark).alias("b"), F.max(F.struct("share", (-F.col("node")).alias("v"))).alias("hub")).filter("m > 1")
    kept = saved(sums.groupBy("m", "a", "b").agg(F.min(F.struct("token", "hub")).alias("t")).select("t.token", (-F.col("t.hub.v")).alias("hub"), (F.col("m") > 2).alias("more")), "often_lists")
    members = rows.join(F.broadcast(kept) if small(kept, BROADCAST_ROWS) else kept, "token")
    return members.filter("node <> hub").select(F.col("token").alias("list"), "hub", "node", "n", "more")


def _batched(spread):
    """Joins the small frames of *spread* into larger ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in spread(batches):
            held.append(frame)
            size += len(frame)
            if size > 100_000:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return run


# ---------------------------------------------------------------- comparisons


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of *docs* whose id is in the one column of *ids*, and a few others: told by a bit for each hash, so that no other text is shuffled."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    word = 1 << 16

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(word, bool)
        bits[group["p"].to_numpy() % word] = True
        return pd.DataFrame({"at": [int(group["p"].iloc[0]) // word], "bits": [np.packbits(bits).tobytes()]})

    places = ids.select(place(ids.columns[0]).alias("p")).distinct()
    got = places.groupBy(F.floor(F.col("p") / word).alias("at")).applyInPandas(packed, "at bigint, bits binary").collect()
    table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in got:
        table[r["at"] * word // 8 : (r["at"] + 1) * word // 8] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def known(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return docs.filter(known(place("id")))


def _compared(pairs: DataFrame, docs: DataFrame, members: DataFrame, percent: int, order: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """a, b, common, a_n, b_n, beyond, rest: the exact intersection sizes of pairs of nodes, from the whole texts of one document of each.

    With *order*, and where the column with_rest of *pairs* is true, held has a bit for each shingle of a, set where b has it too, and then one for each
    part of the hashes, set where b has a shingle that a lacks; rest holds the first of the shingles of b that a lacks, in the global order, as many
    as an index may need; beyond says how many there are. Rows that repeat an id may repeat a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order) if order else None
    ends = saved(pairs.select(F.col("a").alias("short")).union(pairs.select("b")).distinct(), "ends")
    chosen = members.filter("n > 0").join(F.broadcast(ends) if small(ends, BROADCAST_ROWS) else ends, "short", "left_semi").groupBy("short", "node").agg(F.min("id").alias("id"))
    chosen = saved(chosen, "chosen").withColumnRenamed("id", "rep")
    few = small(chosen, BROADCAST_ROWS)
    texts = (docs if few else _among(docs, chosen.select("rep"))).join(F.broadcast(chosen) if few else chosen, F.col("id").eqNullSafe(F.col("rep"))).select("short", "node", "t")
    texts = texts if few else saved(texts, "texts")
    side = lambda x: texts.select(F.col("short").alias(x), F.col("node").alias(f"{x}_node"), F.col("t").alias(f"{x}_t"))
    flag = F.col("with_rest") if "with_rest" in pairs.columns else F.lit(False).alias("with_rest")
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "a_node", "a_t", "b", "b_node", "b_t", flag)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: OrderedDict[bytes, np.ndarray | None] = OrderedDict()

        def tokens(node: bytes, text: str | None) -> np.ndarray | None:
            # Rows that repeat an id may bring a text of another node.
            if (key := xxhash.xxh3_128_digest((text or "").encode()) + node) not in memo:
                found = next(shingle_sets([text]))
                memo[key] = found if _node(found) == node else None
                if len(memo) > 64:
                    memo.popitem(last=False)
            memo.move_to_end(key)
            return memo[key]

        for batch in batches:
            out = []
            for a, an, at, b, bn, bt, more in batch[["a", "a_node", "a_t", "b", "b_node", "b_t", "with_rest"]].itertuples(index=False):
                x, y = tokens(bytes(an), at), tokens(bytes(bn), bt)
                if x is not None and y is not None:
                    there = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                    common, rest, held = int(np.count_nonzero(there)), None, None
                    if more and shared is not None:
                        rest = rest_all = y[~there]
                        need = max(1, -(-percent * len(y) // 100) - common)
                        rest = rest[np.lexsort((rest, _weights_of(rest, *shared.value)))][: max(0, len(rest) - need + 1)].tobytes()
                        bits = np.zeros(-(-len(x) // 64) * 64, bool)
                        bits[np.searchsorted(x, y[there])] = True
                        parts = np.zeros(1 << _PART_BITS, bool)
                        parts[rest_all >> np.uint64(64 - _PART_BITS)] = True
                        held = np.packbits(np.append(parts, bits)).tobytes()
                    out.append((a, b, common, len(x), len(y), len(y) - common, rest, held))
            yield pd.DataFrame(out, columns=["a", "b", "common", "a_n", "b_n", "beyond", "rest", "held"])

    return saved(joined.mapInPandas(releasing(run), "a bigint, b bigint, common int, a_n int, b_n int, beyond int, rest binary, held binary"), "compared")


def open_pairs(n: np.ndarray, common: np.ndarray, held: np.ndarray, rest: np.ndarray, place: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sure): pairs of entries, one of *left* and one of *right*, that may link different components.

    An entry shares *common* shingles with the hub and has *rest* more, in which the list's shingle stands at *place*. Its row of *held* has the bits of parts of the
    hashes of those, then the bits of those that it shares (64 to a word). Entries of *right* go by blocks of like positions and sizes; a block whose bounds fall short for an entry of *left* is skipped whole.
    A pair that what it shares of the hub makes similar by itself is sure: of these come as many as join components, and of the others, which
    sizes and positions leave open, those between components that no sure pair has joined.
    """
    after = rest - place  # the list's shingle and those behind it
    words = (1 << _PART_BITS) // 64
    parts, shared = held[:, :words], held[:, words:]
    right = right[np.lexsort((n[right], common[right], place[right]))]
    blocks = [right[i : i + _SKIP] for i in range(0, len(right), _SKIP)]
    limits = [(n[b].min(), n[b].max(), common[b].max(), place[b].max(), after[b].max()) for b in blocks]
    of = np.unique(comp, return_inverse=True)[1]
    root = np.arange(of.max() + 1 if len(of) else 0)
    out_a, out_b, sure = [], [], []
    for x in left:
        for block, (n0, n1, c1, p1, a1) in zip(blocks, limits):
            if 100 * min(n[x], n1) < percent * max(n[x], n0) or min(common[x], c1) + min(place[x], p1) + min(after[x], a1) < _least_common(n[x], n0, percent):
                continue
            y = block[root[of[block]] != root[of[x]]]
            need, beyond = _least_common(n[x], n[y], percent), np.minimum(place[x], place[y]) + np.minimum(after[x], after[y])
            likely = (np.minimum(common[x], common[y]) + beyond >= need) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            y, need, beyond = y[likely], need[likely], beyond[likely]
            if not len(y):
                continue
            both = np.bitwise_count(shared[x] & shared[y]).sum(axis=1, dtype=np.int64)
            alone = rest[x] - np.bitwise_count(parts[x] & ~parts[y]).sum(axis=1, dtype=np.int64)
            other = rest[y] - np.bitwise_count(parts[y] & ~parts[x]).sum(axis=1, dtype=np.int64)
            beyond = np.minimum(beyond, np.maximum(np.minimum(alone, other), 0))
            for z in y[both >= need]:
                if root[of[z]] != root[of[x]]:
                    root[root == root[of[z]]] = root[of[x]]
                    sure.append((x, z))
            y = y[(both < need) & (both + beyond >= need)]
            out_a.append(np.full(len(y), x))
            out_b.append(y)
    a, b = (np.concatenate([np.empty(0, np.int64), *part]) for part in (out_a, out_b))
    still = root[of[a]] != root[of[b]]
    certain = np.array(sure, np.int64).reshape(-1, 2)
    return np.append(certain[:, 0], a[still]), np.append(certain[:, 1], b[still]), np.append(np.ones(len(certain), bool), np.zeros(int(still.sum()), bool))


def _beyond_hub(near: DataFrame, percent: int) -> DataFrame:
    """list, node, n, comp, common, held, rest, place: the lists that are left after the comparisons with hubs.

    *near* has hub, node, n, comp, common, held, beyond, rest (the first of the shingles beyond the hub, in the global order) and least, the smallest n around the hub. A node that needs k
    shingles beyond the hub in common with any other is listed under the first |rest| - k + 1 of them; one that may need none also under the hub itself.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for hub, node, n, comp, common, held, beyond, rest, least in batch[["hub", "node", "n", "comp", "common", "held", "beyond", "rest", "least"]].itertuples(index=False):
                need = int(_least_common(n, max(int(least), -(-percent * n // 100)), percent)) - common
                tokens = np.frombuffer(rest, np.int64)[: max(0, beyond - max(need, 1) + 1)]
                frame = {"token": tokens, "rest": beyond, "place": np.arange(len(tokens), dtype=np.int32)}
                if need <= 0:  # a list of their own: nothing beyond the hub in common
                    frame = {"token": np.append(tokens, 0), "rest": np.append(np.full(len(tokens), beyond), 0), "place": np.append(frame["place"], 0)}
                out = pd.DataFrame(frame)
                out[["hub", "node", "n", "comp", "common"]] = hub, node, n, comp, common
                out["held"] = [bytes(held)] * len(out)
                yield out

    rows = near.mapInPandas(releasing(_batched(spread)), "token bigint, rest int, place int, hub bigint, node bigint, n int, comp bigint, common int, held binary")
    return rows.withColumn("list", F.xxhash64("hub", "token")).drop("token", "hub")


def _open(members: DataFrame, labels: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """a, b, sure: the pairs of list members that are still open after the comparisons with hubs, or found to be similar by them."""
    spark = members.sparkSession
    hubs = members.select("list", "hub").distinct().select("list", F.col("hub").alias("node"))
    labelled = members.select("list", "node").unionByName(hubs).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = saved(labelled.groupBy("list").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m")).filter("x <> y and m > 2").select("list"), "open_lists")
    if mixed.isEmpty():
        return spark.createDataFrame([], "a bigint, b bigint, sure boolean")
    around = saved(members.join(F.broadcast(mixed) if small(mixed, BROADCAST_ROWS) else mixed, "list").select("hub", "node", "n").distinct(), "open_around")
    sizes = saved(around.groupBy("hub").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "open_hubs")
    known = stars.select(F.col("a").alias("hub"), F.col("b").alias("node"), "common", "held", "beyond", "rest")
    near = around.join(sizes, "hub").join(known, ["hub", "node"]).join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = saved(_beyond_hub(near, percent), "open_rows")
    lists = rows.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("m > 1 and x <> y")
    lists = saved(lists.select("list", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "open_tokens")
    live = rows.join(F.broadcast(lists) if small(lists, BROADCAST_ROWS) else lists, "list")
    cut = live.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    # Many lists go to one group, of about _GROUP rows.
    total = lists.agg(F.sum("blocks")).first()[0] or 0
    parts = max(partitions_for(spark), -(-int(total) // (_GROUP // 100)))
    marked = tasks.withColumn("task", F.xxhash64("list", "p", "q")).withColumn("group", F.pmod("task", F.lit(parts)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task", kind="stable")
        col = lambda c: group[c].to_numpy(np.int64)
        task, node, own, p, q, n, common, rest, place, comp = map(col, ("task", "node", "own", "p", "q", "n", "common", "rest", "place", "comp"))
        bits = group["held"].tolist()
        edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
        found = []
        for i, j in zip(edges[:-1], edges[1:]):
            left, right = np.flatnonzero(own[i:j] == p[i]), np.flatnonzero(own[i:j] == q[i])
            if len(left) and len(right):
                words = np.stack([np.frombuffer(x, np.uint64) for x in bits[i:j]])  # of one hub
                a, b, sure = open_pairs(n[i:j], common[i:j], words, rest[i:j], place[i:j], comp[i:j], left, right, percent)
                a, b = node[i:j][a], node[i:j][b]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b), sure], axis=1))
        out = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1], "sure": out[:, 2].astype(bool)})

    pairs = marked.select("group", "task", "node", "own", "p", "q", "n", "common", "held", "rest", "place", "comp").groupBy("group").applyInPandas(run, "a bigint, b bigint, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))
    return pairs.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def _labelled(docs: DataFrame, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """members (id, th, n, node, short: a row for each document) and node, comp, least (id), first (keyless, id, th: null keys come last): a row for each node."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    keys, counts = _frequent(docs)
    wide = saved(_nodes(docs, keys, counts, percent), "nodes")
    distinct = wide.filter("n > 0").dropDuplicates(["node"])
    parts = _groups(wide.agg(F.sum(F.octet_length("rare"))).first()[0], 8 * GATHER_ENTRIES)
    rare = saved(_rare_lists(distinct.select("node", "n", "share", "rare"), parts, percent), "rare_lists")
    often = _often_lists(wide.filter("octet_length(often) > 0").select("node", "n", "share", "often").dropDuplicates(["node"]), percent)
    often, short = saved(often, "lists"), F.size("nodes") <= SHORT_LIST
    lists = _members(rare.filter(~short)).unionByName(often.filter("more"))
    twos = often.filter("not more").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), F.lit(True).alias("star"))
    pairs = saved(_likely(_pairs(rare.filter(short), percent).union(twos), distinct.select("short", "n", "bits"), percent), "likely_pairs")
    members = wide.select("id", "th", "n", "node", "short")
    stars = lists.select(F.col("hub").alias("a"), F.col("node").alias("b"), F.lit(True).alias("with_rest"))
    stars = stars.union(pairs.filter("star").select("a", "b", F.lit(False))).groupBy("a", "b").agg(F.max("with_rest").alias("with_rest"))
    stars = _compared(saved(stars, "stars"), docs, members, percent, (keys, counts))
    link = f"100 * common >= {percent} * (a_n + b_n - common)"
    labels = saved(components(stars.filter(link).select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    others = pairs.filter("not star").join(done, ["a", "b"], "left_anti").select("a", "b", F.lit(False).alias("sure"))
    rest = _open(lists, labels, stars, percent).unionByName(others).groupBy("a", "b").agg(F.max("sure").alias("sure"))
    rest = saved(rest, "open_pairs")
    if not rest.isEmpty():
        ends = [F.col("a").alias("u"), F.col("b").alias("v")]
        sure = rest.filter("sure").select(*ends)
        if not sure.isEmpty():
            labels = saved(components(labels.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(sure)), "labels")
        comp = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
        apart = F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")
        unsure = saved(rest.filter("not sure").join(comp("a"), "a", "left").join(comp("b"), "b", "left").filter(apart).select("a", "b"), "unsure_pairs")
        if not unsure.isEmpty():
            more = _compared(unsure, docs, members, percent).filter(link).select(*ends)
            labels = saved(components(labels.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(more)), "labels")
    by_node = members.filter("n > 0").groupBy("node", "short").agg(F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("keyless"), "id", "th")).alias("first"))
    by_node = by_node.join(labels.withColumnRenamed("node", "short"), "short", "left").select("node", F.coalesce("comp", "short").alias("comp"), "least", "first")
    return members, saved(by_node, "node_labels")


@tidy
def similar_components(docs: DataFrame, *, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the least doc_id reachable over links.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of distinct shingles of WORDS words. A document of
    fewer words has its whole sequence as one shingle; one without words (a null text too) has none and is a
    component of its own. Rows that repeat a key are documents of their own that happen to have equal ids. Null keys are never the
    least; a component of null keys only has a null component_id. Other columns aren't read. An empty table gives an empty table.
    """
    members, by_node = _labelled(docs, percent, key, text)
    by_comp = saved(by_node.groupBy("comp").agg(F.min("least").alias("component_id")), "component_ids")
    final = saved(by_node.join(by_comp, "comp").select("node", "component_id"), "node_components")
    done = members.join(final, "node", "left")
    return done.select(F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


@tidy
def keep_one_of_each(docs: DataFrame, *, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, all columns as they are: the one of the least key, and of the least text hash among those.

    A document with a null key stays only if its component has no other. Of rows that repeat both key and text exactly one stays, any of
    them. A document without words is a component of its own and stays, however often its row is repeated.
    """
    members, by_node = _labelled(docs, percent, key, text)
    firsts = by_node.groupBy("comp").agg(F.min("first").alias("first")).select("first.id", "first.th")
    counts = members.filter("n > 0").groupBy("id", "th").agg((F.count(F.lit(1)) > 1).alias("again"))
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.th") == F.col("b.th"))
    kept = firsts.alias("a").join(counts.alias("b"), same).select("a.id", "a.th", "again")
    kept = kept.unionByName(members.filter("n = 0").select("id", "th", F.lit(False).alias("again")).distinct())
    id_, th, again = fresh(docs, "_kept"), fresh(docs, "_text_hash"), fresh(docs, "_again")
    kept = saved(kept.toDF(id_, th, again), "kept")

    def found(wanted: DataFrame) -> DataFrame:
        right = F.broadcast(wanted) if small(wanted, BROADCAST_ROWS) else wanted
        return docs.join(right, F.col(key).cast("bigint").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text)) == F.col(th)))

    out, repeated = found(kept.filter(~F.col(again))).select(*docs.columns), kept.filter(again)
    return out if repeated.isEmpty() else out.unionByName(found(repeated).dropDuplicates([id_, th]).select(*docs.columns))
