"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines are sequences of symbols: characters, or words, which is what stands between single spaces. Lines within *max_edits* edits of
each other share one of max_edits + 1 segments, at a place that differs by few symbols: each distinct line puts its segments in an
index keyed by (segment, length, content), and probes the index with the substrings that could match segments of lines that are up to
max_edits shorter. Candidates pass a filter on letter counts (of characters) and are verified by a banded bit-parallel edit distance.

Index keys that more than HOT_KEY lines share are not joined pair by pair. For one edit, deletion neighbourhoods find what stands behind
a near-equal line, in a row for each symbol of those lines. For more edits each such line is compared with the earliest
one under its key, and only lines that this doesn't settle are compared with the others. Either way the same lines go as without hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import fresh, saved, small, tidy, without

#: Distinct lines that may share an index key before it counts as hot.
HOT_KEY = 256
#: Hashes of candidate lines, hot keys and the like are broadcast up to so many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
#: Letters whose counts are compared before the edit distance is.
_LETTERS = ("e", "t", "a", "n", "o", "i")
#: Hashes of symbols at their places are summed: so many bits leave room for lines of 4 million symbols.
_SYMBOL_BITS = 41
_WHITE = " \t\x0b\x0c\r"


def _two_hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(7), line)


def _blank(line: Column) -> Column:
    """Whether a line has nothing but white space."""
    return F.btrim(line, F.lit(_WHITE)) == ""


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, t (hash of the text), n (from 0), line, h, g (its two hashes): a row for each line that isn't blank."""
    split = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    h, g = _two_hashes(F.col("line"))
    return split.filter(~_blank(F.col("line"))).withColumns({"h": h, "g": g})


def _symbols(line: Column, words: bool) -> Column:
    return F.split(line, " ") if words else F.split(line, "")


def _size(line: Column, words: bool) -> Column:
    """How many symbols a line has."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1 if words else F.char_length(line)


def _words(line: Column, first: Column | None, last: Column | None, n: Column) -> Column:
    """The *n* words of a line from *first* to *last*, counted from 1; None for the line's first and last. No array of words is made."""
    index = lambda s, k: F.call_function("substring_index", s, F.lit(" "), k)
    upto = line if last is None else index(line, last)
    return upto if first is None else index(upto, -n)


def _segments(edits: int, least: int, words: bool) -> list[Column]:
    """Keys of the columns line and size: those of its edits + 1 own segments, then of what it may share with shorter lines.

    The key of a substring that would reach beyond the line is null, and so are those of lines of fewer than *least* symbols.
    """
    size, own_keys, probes = F.col("size"), [], []
    for shorter in range(edits + 1):
        length = size - shorter
        longer = length % (edits + 1)
        base = ((length - longer) / (edits + 1)).cast("int")
        for i in range(1, edits + 2):
            # The last *longer* segments have one symbol more.
            extra = F.greatest(longer - (edits + 1 - i) - 1, F.lit(0))
            start = base * (i - 1) + extra
            own = base + F.when(longer > edits + 1 - i, 1).otherwise(0)
            low, high = max(1 - i, shorter - (edits + 1 - i)), min(i - 1, shorter + (edits + 1 - i))
            for shift in range(low, high + 1):
                at = start + shift + 1
                fits = (size >= least) & (at >= 1) & (at + own - 1 <= size)
                piece = _words(F.col("line"), None if i == 1 else at, None if i == edits + 1 else at + own - 1, own) if words else F.col("line").substr(at, own)
                (probes if shorter or shift else own_keys).append(F.when(fits, F.xxhash64(F.lit(i), length, piece)))
    return own_keys + probes


def banded_distance(a: str, b: str, edits: int, words: bool = False) -> Column:
    """Edit distance of the columns *a* and *b* in characters or words, or a number above *edits* if it is more.

    Bits of a word of 2 * edits + 1 stand for the rows of one column of the table that are in the band around
    the diagonal; the word slides down with the columns. Deltas between cells are kept as bit vectors (vp, vn: one
    more, one less than above), and d follows the lower rim of the band, then the last row.
    """
    mask, top = (1 << (2 * edits + 1)) - 1, 2 * edits
    start = mask & ~((1 << edits) - 1)
    rows = " | ".join(f"if(coalesce(get(x.a, j - {edits} + {k} - 1) = get(x.b, j - 1), false), {1 << k}L, 0L)" for k in range(top + 1))
    d0 = f"(((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {mask}L)"
    hp = f"((s.vn | ~(z | s.vp)) & {mask}L)"
    hn = "(z & s.vp)"
    rim = f"s.d + 1 - cast(shiftright(z, {top}) & 1L as int)"
    last = f"s.d + cast(shiftright({hp}, x.m - j + {edits}) & 1L as int) - cast(shiftright({hn}, x.m - j + {edits}) & 1L as int)"
    step = f"named_struct('vp', ({hn} | ~(shiftright(z, 1) | {hp})) & {mask}L, 'vn', shiftright(z, 1) & {hp}, 'd', if(j <= x.m - {edits}, {rim}, {last}))"
    bound = f"get(transform(array({rows}), pm -> get(transform(array({d0}), z -> {step}), 0)), 0)"
    far = edits + 1
    walk = f"aggregate(sequence(1, x.n), named_struct('vp', {start}L, 'vn', 0L, 'd', {edits}), (s, j) -> {bound}, s -> s.d)"
    # Where the band is wider than the table: of words no line is that short.
    plain = f"{far}" if words else "levenshtein(array_join(x.a, ''), array_join(x.b, ''))"
    body = f"if(abs(x.m - x.n) > {edits}, {far}, if(x.m <= {edits} or x.n = 0, {plain}, {walk}))"
    symbols = lambda c: f"split({c}, ' ')" if words else f"filter(split({c}, ''), q -> q <> '')"
    return F.expr(f"get(transform(array(named_struct('a', {symbols(a)}, 'b', {symbols(b)})), y -> get(transform(array(named_struct('a', y.a, 'b', y.b, 'm', size(y.a), 'n', size(y.b))), x -> {body}), 0)), 0)")


def _chosen(rows: DataFrame, wanted: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """A semi or anti join with what is broadcast if few."""
    return rows.join(F.broadcast(wanted) if small(wanted, BROADCAST_ROWS) else wanted, on, how)


def _verified(candidates: DataFrame, texts: DataFrame, edits: int, words: bool) -> DataFrame:
    """h1, g1, h2, g2: those of the *candidates* (h1, h2) that are within *edits* edits."""
    needed = saved(candidates.select(F.col("h1").alias("h")).union(candidates.select(F.col("h2").alias("h"))).distinct(), "needed")
    found = saved(_chosen(texts, needed, "h", "left_semi").distinct(), "needed_lines")
    side = lambda x: found.select(F.col("h").alias(f"h{x}"), F.col("g").alias(f"g{x}"), F.col("line").alias(f"l{x}"))
    both = candidates.join(side(1), "h1").join(side(2), "h2")
    if not words:
        counts = lambda c: [F.char_length(c) - F.char_length(F.replace(F.col(c), F.lit(x), F.lit(""))) for x in _LETTERS]
        apart = sum((F.abs(x - y) for x, y in zip(counts("l1"), counts("l2"))), F.lit(0))
        both = both.filter((F.abs(F.char_length("l1") - F.char_length("l2")) <= edits) & (apart <= 2 * edits))
    return both.filter(banded_distance("l1", "l2", edits, words) <= edits).select("h1", "g1", "h2", "g2")


def _near_pairs(lines: DataFrame, firsts: DataFrame, edits: int, least: int, words: bool) -> DataFrame:
    """h1, g1, h2, g2: pairs of distinct lines within *edits* edits, in no given order; of hot keys as many as show which lines have an earlier one."""
    texts = lines.select("h", "g", "line")
    sized = texts.select("h", "line", _size(F.col("line"), words).alias("size"))
    # Keys are columns before they are rows: generated code of all of them inside of an explode is too long to be compiled well.
    keys = {f"k{i}": k for i, k in enumerate(_segments(edits, least, words))}
    wide = sized.select("h", *[k.alias(n) for n, k in keys.items()])
    spread = wide.select("h", F.posexplode(F.array(*keys)).alias("place", "key")).select("key", "h", (F.col("place") > edits).alias("probe")).filter(F.col("key").isNotNull())
    segments = saved(spread.distinct(), "segments")
    own, pairs = segments.filter(~F.col("probe")).select("key", F.col("h").alias("h1")), []
    hot = saved(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_KEY).select("key"), "hot_keys")
    if not hot.isEmpty():
        crowd = saved(_chosen(segments, hot, "key", "left_semi"), "hot_segments")
        hot_lines = saved(crowd.select("h").distinct(), "hot_lines")
        known = saved(_chosen(firsts, hot_lines, "h", "left_semi"), "hot_firsts")
        if edits == 1:
            met = saved(_chosen(texts, hot_lines, "h", "left_semi").distinct(), "hot_texts")
            pairs.append(_deletion_pairs(met.join(known, ["h", "g"]), words))
        else:
            pairs += _settled(crowd, known, texts, edits, words)
        segments, own = _chosen(segments, hot, "key", "left_anti"), _chosen(own, hot, "key", "left_anti")
    met = own.join(segments.select("key", F.col("h").alias("h2"), "probe"), "key").filter((F.col("h1") != F.col("h2")) & (F.col("probe") | (F.col("h1") < F.col("h2"))))
    pairs.append(_verified(saved(met.select("h1", "h2").distinct(), "candidates"), texts, edits, words))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.union(p)
    return out


def _settled(crowd: DataFrame, firsts: DataFrame, texts: DataFrame, edits: int, words: bool) -> list[DataFrame]:
    """Pairs among the lines of hot keys (*crowd*: key, h, probe) that show which of them have an earlier one.

    Under each key all are compared with the earliest of them. A line that is near it is settled; others are compared with all earlier ones.
    """
    placed = saved(crowd.select("key", "h").distinct().join(firsts.groupBy("h").agg(F.min("first").alias("first")), "h"), "hot_placed")
    hubs = saved(placed.groupBy("key").agg(F.min(F.struct("first", "h")).alias("m")).select("key", F.col("m.h").alias("hub")), "hot_hubs")
    around = placed.join(hubs, "key").filter("h <> hub").select(F.col("hub").alias("h1"), F.col("h").alias("h2")).distinct()
    near = saved(_verified(saved(around, "hot_candidates"), texts, edits, words), "hot_near")
    left = placed.join(near.select(F.col("h2").alias("h")).distinct(), "h", "left_anti")
    left = left.join(hubs, "key").filter("h <> hub").select("key", F.col("h").alias("h2"), F.col("first").alias("f2"))
    others = placed.select("key", F.col("h").alias("h1"), F.col("first").alias("f1")).join(left, "key").filter("f1 < f2").select("h1", "h2").distinct()
    return [near, _verified(saved(others, "hot_others"), texts, edits, words)]


def _deletion_pairs(lines: DataFrame, words: bool) -> DataFrame:
    """Pairs one edit apart among *lines* (h, g, line, first): a row for each symbol, none verified pair by pair.

    Lines that become equal without the symbol at one place are one substitution apart: each is paired with the
    earliest of them, whose *first* is least, so that all others are found to have one before them. A line that becomes another one
    without a symbol is one deletion apart. What is left of a line is told by sums of hashes of its symbols at their places.
    """
    cut = lines.select("h", "g", "first", F.posexplode(_symbols(F.col("line"), words)).alias("p", "c"))
    if not words:
        cut = cut.filter("c <> ''")
    hashed = lambda seed, place: F.pmod(F.xxhash64(F.lit(seed), F.col("c"), place), F.lit(1 << _SYMBOL_BITS))
    whole, before = Window.partitionBy("h", "g"), Window.partitionBy("h", "g").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums, rests = {"size": F.count(F.lit(1)).over(whole)}, {}
    for name, seed in (("rh", 1), ("rg", 2)):
        cut = cut.withColumns({f"{name}_here": hashed(seed, F.col("p")), f"{name}_back": hashed(seed, F.col("p") - 1)})
        sums |= {f"{name}_whole": F.sum(f"{name}_here").over(whole), f"{name}_all": F.sum(f"{name}_back").over(whole)}
        sums |= {f"{name}_left": F.coalesce(F.sum(f"{name}_here").over(before), F.lit(0)), f"{name}_gone": F.coalesce(F.sum(f"{name}_back").over(before), F.lit(0))}
        rests[name] = F.col(f"{name}_left") + F.col(f"{name}_all") - F.col(f"{name}_gone") - F.col(f"{name}_back")
    cut = saved(cut.withColumns(sums).withColumns(rests).select("h", "g", "first", "p", "size", "rh", "rg", "rh_whole", "rg_whole"), "hot_rests")
    least = cut.groupBy("size", "p", "rh", "rg").agg(F.min(F.struct("first", "h", "g")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    swapped = cut.drop("first").join(least, ["size", "p", "rh", "rg"]).filter(F.col("h") != F.col("m.h")).select(F.col("m.h").alias("h1"), F.col("m.g").alias("g1"), F.col("h").alias("h2"), F.col("g").alias("g2"))
    wholes = cut.filter("p = 0").select(F.col("h").alias("h1"), F.col("g").alias("g1"), (F.col("size") + 1).alias("size"), F.col("rh_whole").alias("rh"), F.col("rg_whole").alias("rg"))
    shorter = cut.join(wholes, ["size", "rh", "rg"]).select("h1", "g1", F.col("h").alias("h2"), F.col("g").alias("g2"))
    return swapped.union(shorter).distinct()


@tidy
def dedup_lines(docs: DataFrame, *, max_edits: int = 1, min_size: int = 8, unit: str = "word", key: str = "doc_id", text: str = "text") -> DataFrame:
    """*docs* with every line removed from *text* that has an earlier duplicate, and ``lines_removed`` int.

    Lines end with line feeds and are ordered by (key, hash of the text, place). A line is removed if the same line stands
    anywhere before it, or, for lines of at least *min_size* symbols, one within *max_edits* edits (insertions, deletions
    and substitutions of symbols), whether that one stays or not: of any chain of near-equal lines the first stays. Symbols are
    characters or words as *unit*, "char" or "word", says; words are what stands between single spaces, and may be empty.
    Lines of nothing but white space aren't looked at and stay. Lines keep their order; a text may become empty, its row stays.

    A null text stays null with 0 lines removed. Null keys come before others. Rows that repeat both key and text count as
    one document, and get equal results. Other columns are carried as they are; an input column named lines_removed is
    replaced. An empty table gives an empty table.
    """
    if max_edits < 0 or min_size <= max_edits or unit not in ("char", "word"):
        raise ValueError("min_size must exceed max_edits, which is 0 or more, and unit must be char or word")
    docs = without(docs, "lines_removed")
    lines = _lines(docs, key, text)
    firsts = saved(lines.groupBy("h", "g").agg(F.min(F.struct("k", "t", "n")).alias("first")), "first_lines")
    kept = firsts
    if max_edits:
        pairs = saved(_near_pairs(lines, firsts, max_edits, min_size, unit == "word"), "near_lines")
        ends = saved(pairs.select(F.col("h1").alias("h"), F.col("g1").alias("g")).union(pairs.select("h2", "g2")).distinct(), "near_ends")
        known = saved(_chosen(firsts, ends, ["h", "g"], "left_semi"), "near_firsts")
        at = lambda x: known.select(F.col("h").alias(f"h{x}"), F.col("g").alias(f"g{x}"), F.col("first").alias(f"f{x}"))
        placed = pairs.join(at(1), ["h1", "g1"]).join(at(2), ["h2", "g2"])
        near = _linked_to_earlier(placed)
        kept = _chosen(firsts, saved(near, "later_lines"), ["h", "g"], "left_anti")
    ours, mark, theirs, k = (fresh(docs, x) for x in ("_kept", "_text_hash", "_kept_hash", "_kept_key"))
    by_doc = kept.select("first.*").groupBy(F.col("k").alias(k), F.col("t").alias(theirs)).agg(F.collect_list("n").alias(ours))
    joined = docs.withColumn(mark, F.xxhash64(F.col(text))).join(by_doc, F.col(key).eqNullSafe(F.col(k)) & (F.col(theirs) == F.col(mark)), "left")
    blank = f"btrim(get(x.a, i), '{_WHITE}') = ''"
    rebuilt = F.expr(
        f"""get(transform(array(named_struct('a', split(`{text}`, '\n'), 'k', coalesce(`{ours}`, cast(array() as array<int>)))), x ->
            get(transform(array(array_sort(array_union(x.k, filter(sequence(0, size(x.a) - 1), i -> {blank})))), q ->
                struct(if(size(q) = size(x.a), `{text}`, array_join(transform(q, i -> get(x.a, i)), '\n')) as text, cast(size(x.a) - size(q) as int) as n)), 0)), 0)"""
    )
    done = joined.withColumn(ours, F.when(F.col(text).isNotNull(), rebuilt))
    cells = [F.col(f"{ours}.text").alias(c) if c.lower() == text.lower() else F.col(c) for c in docs.columns]
    return done.select(*cells, F.coalesce(F.col(f"{ours}.n"), F.lit(0)).alias("lines_removed"))


def _linked_to_earlier(placed: DataFrame) -> DataFrame:
    """h, g of each line in a pair that stands after the other one."""
    later = F.when(F.col("f1") < F.col("f2"), F.struct(F.col("h2").alias("h"), F.col("g2").alias("g"))).otherwise(F.struct(F.col("h1").alias("h"), F.col("g1").alias("g")))
    return placed.select(later.alias("x")).select("x.*").distinct()
