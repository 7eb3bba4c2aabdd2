"""Fuzzy line dedup by MinHash, in DataFrame functions only (operator 10).

A line's shingles are the SHINGLE characters (UTF-16 units) from every one of its
characters. One hash of each gives a one-permutation MinHash: hash space is cut into BINS
bins, of each of which the least hash counts. A band is three bins: a line of the affine
plane over them, twelve bands any two bins of which are in one. Lines share no band only if
the bins in which they differ, five of nine at least, meet every band. At a Jaccard
similarity of 0.8 that happens to less than 2 pairs in 100, and to fewer above.

Lines that share a band form a bucket; equal lines are one node from the start. First every
line of a bucket is compared with its PIVOTS most central ones, that share the most and
largest buckets, by exact Jaccard. That settles small buckets and most families of copies. A
larger bucket that still holds several components is then settled: all its pairs of lines of
different components are compared, tile by tile, those that a sketch rules out excepted.
The components are those that all pairs of all buckets give; no family is paired off.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, forget, join_dealt
from .components import components

SHINGLE, ORDER, PIVOTS, SIMILARITY = 9, 3, 4, 0.8
BINS = ORDER * ORDER
#: The lines of the affine plane: upright ones, then those of each slope.
BANDS = [tuple(ORDER * x + y for y in range(ORDER)) for x in range(ORDER)]
BANDS += [tuple(ORDER * x + (slope * x + at) % ORDER for x in range(ORDER)) for slope in range(ORDER) for at in range(ORDER)]
#: Least hashes are first sought among so many of a line's shingles for each bin, as are to be expected.
NARROWED = 8
#: 64-bit words of a sketch, bytes of a UTF-16 unit, words of the filter of wanted keys (two megabytes).
SKETCH, WIDE, FILTER = 32, 2, 1 << 18
#: Lines in one part of a large bucket.
TILE = 1024
#: Lines and their hashes hardly repeat within a file, so no dictionary is tried.
PLAIN = {"parquet.enable.dictionary": "false"}
#: White space within lines.
BLANKS = " \t\x0b\x0c\r"


def shingle(wide: Column, start: Column) -> Column:
    """Hash of the shingle from one byte of a line in UTF-16, where it is found without counting through the line."""
    return F.xxhash64(F.substring(wide, start, F.lit(WIDE * SHINGLE)))


def starts(wide: Column) -> Column:
    """The first byte of each of its shingles, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - WIDE * (SHINGLE - 1), F.lit(1)), F.lit(WIDE))


def shingles(line: Column) -> Column:
    """Hashed shingles from every character; of the line itself if it is shorter."""
    return F.transform(F.array(F.encode(line, "UTF-16BE")), lambda w: F.transform(starts(w), lambda i: shingle(w, i)))[0]


def worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns, each worked out once a row: Spark would move a filter on a mere projection of them below it, and work them out there anew."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _copy, _no, _line): every line that has a word. _copy tells texts of one id apart."""
    rows = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_copy"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_no", "_line"))
    return rows.where(F.ltrim(F.col("_line"), F.lit(BLANKS)) != "")


def sketches(texts: DataFrame) -> DataFrame:
    """(_key, _n, _x0, ...) from (_key, _line): the number of different shingles, and bits that each of them flips: sets that differ in k shingles differ in k bits at most.

    Shingles that two lines share cancel out, so their number doesn't blur the difference.
    """
    word, bit = F.shiftrightunsigned("_h", 6).bitwiseAND(F.lit(SKETCH - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_h").bitwiseAND(F.lit(63)).cast("int"))
    rows = worked_out(texts.repartition("_key"), _all=shingles(F.col("_line"))).select("_key", F.explode(F.array_distinct("_all")).alias("_h"))
    # a line's words one by one, then side by side: a shingle touches one word, not all of them
    words = rows.select("_key", word.alias("_word"), bit.alias("_bit")).groupBy("_key", "_word").agg(F.count("*").alias("_n"), F.bit_xor("_bit").alias("_bits"))
    bits = [F.bit_or(F.when(F.col("_word") == i, F.col("_bits"))) for i in range(SKETCH)]
    return words.groupBy("_key").agg(F.sum("_n").alias("_n"), *[F.coalesce(b, F.lit(0).cast("long")).alias(f"_x{i}") for i, b in enumerate(bits)])


def may_be_near(u: str, v: str) -> Column:
    """Whether the sketches of two lines allow them to be similar.

    Similarity t allows sizes a and b a difference of (a + b) (1 - t) / (1 + t) shingles;
    lines whose sketches differ in more bits can't reach it.
    """
    words = [F.bit_count(F.col(f"{u}_x{i}").bitwiseXOR(F.col(f"{v}_x{i}"))) for i in range(SKETCH)]
    most = ((F.col(u + "_n") + F.col(v + "_n")) * (1 - SIMILARITY) + 1e-6) / (1 + SIMILARITY)
    near = F.lit(True)
    for n in (4, 8, 16, SKETCH):  # a few words tell most lines apart; the rest are then not looked at
        near = near & (reduce(add, words[:n]) <= most)
    return near


def similar(pairs: DataFrame, u: str, v: str) -> DataFrame:
    """Those of the pairs whose lines are similar enough, by the shingles themselves.

    The sets stand in columns, not within a lambda, where Spark would intersect them object by object.
    """
    sets = worked_out(pairs, _u_all=shingles(F.col(u + "_line")), _v_all=shingles(F.col(v + "_line")))
    sets = worked_out(sets, _shared=F.size(F.array_intersect("_u_all", "_v_all")))
    return sets.where(F.col("_shared") >= SIMILARITY * (F.col(u + "_n") + F.col(v + "_n") - F.col("_shared")))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the written pairs (u, v, u_n, v_n) whose lines are similar enough."""
    u, v = (texts.select(F.col("_key").alias(c), F.col("_line").alias(c + "_line")) for c in "uv")
    both = join_dealt(join_dealt(pairs, u, "u"), v, "v", counts=pairs.groupBy("v").agg(F.count("*").alias("_n")))
    return similar(both, "u", "v").select("u", "v")


def least_hashes(lines: DataFrame, narrowed: int | None) -> DataFrame:
    """(_key, _top, _m0, ...): each line's least hash in every bin.

    ``narrowed`` has only hashes up to _top looked at, below which so many a bin are to be
    expected, and the first shingle's. What is found up to _top is the least of all.
    """
    most = (1 << 31) - 1
    wide = lines.select("_key", F.encode("_line", "UTF-16BE").alias("_wide"))
    n = F.greatest(F.octet_length("_wide") / WIDE - (SHINGLE - 1), F.lit(1))
    top = F.lit(most) if narrowed is None else F.least(F.lit(most), F.floor(F.lit(float(narrowed * BINS << 32)) / n) - (1 << 31)).cast("int")
    rows = wide.select("_key", "_wide", top.alias("_top")).select("_key", "_wide", "_top", F.explode(starts(F.col("_wide"))).alias("_start"))
    rows = rows.select("_key", "_top", "_start", shingle(F.col("_wide"), F.col("_start")).alias("_h"))
    # the bin is the hash's high half, so the low half, as an integer, orders and tells hashes apart within it
    one = rows.select("_key", "_top", "_start", F.shiftright(F.shiftrightunsigned("_h", 32) * BINS, 32).cast("int").alias("_bin"), (F.col("_h").bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int").alias("_low_half"))
    one = one.where("_low_half <= _top or _start = 1")
    # one row a line from here on, equal lines being one; combined in each task before the shuffle
    return one.groupBy("_key").agg(F.max("_top").alias("_top"), *[F.min(F.when(F.col("_bin") == i, F.col("_low_half"))).alias(f"_m{i}") for i in range(BINS)])


def signatures(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(_key, _b0, ...): the bands of each line (_key, _line), null where all its bins are empty; and the written tables that this reads.

    Lines of which narrowing may have missed a least hash, as of those whose shingles are
    mostly repeats, are gone through again, whole.
    """
    first = cut_lineage(least_hashes(lines, NARROWED))
    missed = F.lit(False)
    for i in range(BINS):
        missed = missed | F.col(f"_m{i}").isNull() | (F.col(f"_m{i}") > F.col("_top"))
    missed = missed & (F.col("_top") < (1 << 31) - 1)
    doubtful = cut_lineage(first.where(missed).select("_key"))
    again = cut_lineage(least_hashes(texts_of(lines, doubtful), None))
    forget(doubtful)
    bands = [F.when(F.coalesce(*[f"_m{i}" for i in band]).isNotNull(), F.xxhash64(F.lit(k), *[f"_m{i}" for i in band])).alias(f"_b{k}") for k, band in enumerate(BANDS)]
    return first.where(~missed).union(again).select("_key", *bands), [first, again]


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose hashed ``key`` isn't among the wanted ones, before they are shuffled.

    A filter of one bit for each hash value modulo 64 * FILTER, of FILTER rows whatever the
    corpus, is broadcast. Full, it keeps every row; the join that follows decides.
    """
    spot = F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(FILTER - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    bits = wanted.select(spot.alias("_spot"), bit.alias("_bit")).groupBy("_spot").agg(F.bit_or("_bit").alias("_bits"))
    return rows.withColumn("_at", spot).join(F.broadcast(bits), (F.col("_at") == F.col("_spot")) & (F.col("_bits").bitwiseAND(bit) != 0), "left_semi").drop("_at")


def buckets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets with more than one line, from written signatures: (_band, _key, _n) for each line in them, and (_band, _n)."""
    keyed = signed.select("_key", F.explode(F.array(*[f"_b{k}" for k in range(len(BANDS))])).alias("_band")).where(F.col("_band").isNotNull())
    # counts combine in each task, so a large bucket costs no more than its rows
    shared = cut_lineage(keyed.groupBy("_band").agg(F.count("*").alias("_n")).where("_n > 1"))
    return cut_lineage(join_dealt(likely(keyed, "_band", shared), shared, "_band", counts=shared)), shared


def pivot_pairs(members: DataFrame, shared: DataFrame) -> DataFrame:
    """(u, v), u > v: every line of a bucket with its PIVOTS most central lines, once."""
    weight = members.groupBy("_key").agg(F.sum("_n").alias("_weight"))
    rank = F.row_number().over(Window.partitionBy("_band").orderBy(F.desc("_weight"), "_key"))
    pivots = members.join(weight, "_key").withColumn("_rank", rank).where(F.col("_rank") <= PIVOTS).groupBy("_band").agg(F.collect_list("_key").alias("_pivots"))  # PIVOTS keys at most
    pairs = join_dealt(members, pivots, "_band", counts=shared).select("_key", F.explode("_pivots").alias("_pivot")).where("_key <> _pivot")
    return pairs.select(F.greatest("_key", "_pivot").alias("u"), F.least("_key", "_pivot").alias("v")).distinct()


def sketched(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the written pairs (u, v) that their sketches don't rule out, with the sizes of both sets."""
    u, v = (marks.select(F.col("_key").alias(c), *[F.col(m).alias(c + m) for m in marks.columns[1:]]) for c in "uv")
    both = join_dealt(join_dealt(pairs, u, "u"), v, "v", counts=pairs.groupBy("v").agg(F.count("*").alias("_n")))
    # within a lambda, the test is kept out of the join's one method, which gets too large to be compiled
    return both.where(F.exists(F.array(may_be_near("u", "v")), lambda near: near)).select("u", "v", "u_n", "v_n")


def open_buckets(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(_band, _key, _root, _parts): lines of the buckets of more than PIVOTS + 1 that still hold several components."""
    named = members.join(joined, F.col("_key") == F.col("node"), "left").select("_band", "_key", F.coalesce("root", "_key").alias("_root"))
    still = named.groupBy("_band").agg(F.count("*").alias("_n"), F.min("_root").alias("_first"), F.max("_root").alias("_last")).where((F.col("_n") > PIVOTS + 1) & (F.col("_first") < F.col("_last")))
    still = cut_lineage(still.select("_band", "_n", F.ceil(F.col("_n") / TILE).cast("int").alias("_parts")))
    return join_dealt(named, still.drop("_n"), "_band", counts=still.select("_band", "_n"))


def open_links(still: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): the similar lines of different components in each open bucket.

    A bucket of more than TILE lines is cut into parts, and each two of them are a key of
    the join, so no key has more than TILE lines a side. Lines are compared where they
    meet, in the first bucket that they share, if sketches allow: only links leave the join.
    """
    shared = still.groupBy("_key").agg(F.collect_list("_band").alias("_open"))  # a line's buckets, one for each of BANDS at most
    rows = still.join(marks, "_key").join(texts, "_key").join(shared, "_key").withColumn("_part", F.pmod(F.xxhash64("_key"), F.col("_parts")).cast("int"))
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    held = ["_key", "_root", "_open", "_line", *marks.columns[1:]]
    first, second = F.least("_part", "_other").alias("_i"), F.greatest("_part", "_other").alias("_j")
    left = dealt.where("_part <= _other").select("_band", first, second, *held)
    right = dealt.where("_other <= _part").select("_band", first, second, *held)
    left, right = (df.select(*[F.col(c).alias(side + c) for c in df.columns]) for side, df in (("a", left), ("b", right)))
    tile = F.expr("a_band = b_band and a_i = b_i and a_j = b_j")
    apart = F.expr("a_root <> b_root and (a_i < a_j or a_key > b_key)")
    # by its lambda, Spark compiles the condition in small methods; as part of the join's one large method it takes several times as long
    here = ~F.exists(F.array_intersect("a_open", "b_open"), lambda band: band < F.col("a_band"))
    links = similar(left.join(right, tile & apart & F.when(may_be_near("a", "b"), here).otherwise(False)), "a", "b")
    return links.select(F.col("a_key").alias("u"), F.col("b_key").alias("v"))


def texts_of(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(_key, _line), once, of the wanted lines."""
    return likely(lines, "_key", keys).select("_key", "_line").distinct().join(keys, "_key", "left_semi")


def line_classes(lines: DataFrame) -> DataFrame:
    """(node, root): of lines (_key, _line), keyed by 64-bit hash, those that belong with another line, and the least of their component."""
    signed, held = signatures(lines)
    members, shared = buckets(signed)
    forget(*held)
    keys = cut_lineage(members.select("_key").distinct())
    texts = cut_lineage(texts_of(lines, keys))
    marks = cut_lineage(sketches(texts))
    first = cut_lineage(pivot_pairs(members, shared))
    pairs = cut_lineage(sketched(first, marks))
    near = cut_lineage(_verified(pairs, texts))
    joined = components(near)
    still = cut_lineage(open_buckets(members, joined))
    more = cut_lineage(joined.select(F.col("node").alias("u"), F.col("root").alias("v")).union(open_links(still, marks, texts)))
    every = components(more)
    forget(members, shared, keys, texts, marks, first, pairs, near, joined, still, more)
    return every


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: id_col, line_no (from 0), first_id, first_line_no, kept.

    first_id and first_line_no name the first line of the component, by id and line number
    (nulls first); it alone is kept. Rows equal in id and text are one document and share
    every decision; rows of one id with different texts are told apart. Null and empty
    texts, and lines without a word, have no row and aren't touched. Other columns are
    ignored; an empty table gives no rows.
    """
    lines = line_table(docs, id_col, text_col)
    written = cut_lineage(lines.select("_doc", "_copy", "_no", F.xxhash64("_line").alias("_key"), "_line"), **PLAIN)
    every = written.drop("_line")
    classes = line_classes(written.select("_key", "_line"))
    least = every.groupBy("_key").agg(F.min(F.struct("_doc", "_no", "_copy")).alias("_own"), F.count("*").alias("_n"))
    named = least.join(classes.withColumn("_in", F.lit(True)), F.col("_key") == F.col("node"), "left").join(classes.select(F.col("root").alias("_root_key")).distinct(), F.col("_key") == F.col("_root_key"), "left")
    # lines that occur once and are like no other stand for themselves and need no row
    named = named.where("_n > 1 or _in or _root_key is not null").select("_key", "_own", "_n", F.coalesce("root", "_key").alias("_class"))
    named = cut_lineage(named)
    shared = cut_lineage(named.groupBy("_class").agg(F.min("_own").alias("_first"), F.count("*").alias("_n")))
    firsts = cut_lineage(join_dealt(named, shared.drop("_n"), "_class", counts=shared.select("_class", "_n")).select("_key", "_n", "_first"))
    own = F.struct("_doc", "_no", "_copy")
    out = join_dealt(every, firsts.drop("_n"), "_key", counts=firsts.select("_key", "_n"), how="left").withColumn("_first", F.coalesce("_first", own))
    kept = F.col("_first").eqNullSafe(own)
    forget(classes, named, shared)
    return out.select(F.col("_doc").alias(id_col), F.col("_no").alias("line_no"), F.col("_first._doc").alias("first_id"), F.col("_first._no").alias("first_line_no"), kept.alias("kept"), "_copy")


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that aren't kept, columns as they were.

    Every document stays; one that has lost all its lines has an empty text.
    """
    gone = dedup_lines(docs, id_col=id_col, text_col=text_col).where(~F.col("kept"))
    gone = gone.groupBy(F.col(id_col).alias("_of"), F.col("_copy").alias("_copy_of")).agg(F.collect_set("line_no").alias("_gone"))  # no more than the document's own lines
    marked = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col(id_col).alias("_key_id"), F.xxhash64(text_col).alias("_key_text"))
    both = marked.join(gone, F.col("_key_id").eqNullSafe(F.col("_of")) & (F.col("_key_text") == F.col("_copy_of")), "left")
    text = F.col("_row").getField(text_col)
    gone_map = F.map_from_arrays(F.col("_gone"), F.transform("_gone", lambda x: F.lit(True)))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: gone_map[i].isNull()), "\n")
    cleaned = F.when(F.col("_gone").isNull(), text).otherwise(left)
    return both.select(*[(cleaned if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])
