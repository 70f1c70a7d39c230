"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, long ones cut every ``PIECE`` characters) are hashed to 64 bits.
Each digest goes to one cell in each of three parts of a sketch; a cell holds how many
digests it got, their xor and the xor of their check values. Each version is sketched once for its
comparisons, and two versions' sketches are subtracted cell by cell, so that common digests vanish whatever the
texts' length. Peeling then recovers what differs: a cell with one digest (count 1 or -1 and a
matching check) gives that digest, which is taken out of its other cells, and so on, part after
part. The likeness follows from the recovered digests and the sketches' counts. Pairs whose
peeling leaves something over are sketched again with four times the cells (pairs whose numbers of
paragraphs alone differ by more than the cells hold wait for a size that can do it).

Everything is DataFrame functions. A sketch is a table of non-empty cells, and all cells of
a document stay in its partition: texts are shuffled once, digests once more, and no step of
subtraction or peeling moves anything.

Defined results
- null, empty or blank texts: no paragraphs, the empty fingerprint; two such texts have
  likeness 1, one such and another 0;
- repeated paragraphs of a text count once;
- rows of one doc_id: in order of their texts, each a document; null doc_id: before all;
- a table of one row is its own next document; an empty table gives an empty result;
- other columns are ignored whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, materialize, partitions, quantile_bounds, range_bucket

PIECE = 160
CELLS = 96
PARTS = 3
ROUNDS = 15
TOTAL, FOUND = -1, -3  # cells of all digests (-2 for the right version's) and of recovered ones
EDITED, NEXT = 0, 1  # kinds of comparison


def paragraph_digests(text: Column, piece: int = PIECE) -> Column:
    """array<bigint>: distinct digests of the text's paragraphs."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")

    def cut(line: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.char_length(line) - 1) / piece).cast("int")), lambda i: F.xxhash64(F.substr(line, i * piece + 1, F.lit(piece))))

    return F.array_distinct(F.coalesce(F.flatten(F.transform(lines, cut)), F.array().cast("array<bigint>")))


def check_of(digest: Column) -> Column:
    """A digest's check value."""
    return F.xxhash64(F.lit("check"), digest)


def cell_of(digest: Column, part: Column, cells: int) -> Column:
    """The digest's cell in a part: parts have a third of the cells each."""
    width = cells // PARTS
    return (part * width + F.pmod(F.xxhash64(F.lit("cell"), part, digest), F.lit(width))).cast("int")


def sketch_cells(digests: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """(keys, cell, n, x, c) from rows (keys, digest): count, xor of digests, xor of check values.

    Cell TOTAL has all of a version's digests; a version without any, given by a row of a null
    digest, has that cell alone.
    """
    parts = F.when(F.col("digest").isNull(), F.array(F.lit(TOTAL))).otherwise(F.array(*[F.lit(i) for i in (TOTAL, *range(PARTS))]))
    spread = digests.select(*keys, F.col("digest").alias("x"), F.explode(parts).alias("part"))
    cell = F.when(F.col("part") == TOTAL, F.lit(TOTAL)).otherwise(cell_of(F.col("x"), F.col("part"), cells))
    placed = spread.select(*keys, cell.alias("cell"), F.when(F.col("x").isNull(), 0).otherwise(1).alias("n"), "x", check_of(F.col("x")).alias("c"))
    return placed.groupBy(*keys, "cell").agg(F.sum("n").cast("bigint").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))


def difference(signed: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches subtracted: from rows (keys, s, cell, n, x, c), s being 1 for the left and -1 for the right version's.

    The versions' counts stay apart in the cells TOTAL and TOTAL - 1; cells that come to nothing go.
    """
    total = F.col("cell") == TOTAL
    cell = F.when(total & (F.col("s") < 0), F.lit(TOTAL - 1)).otherwise(F.col("cell"))
    placed = signed.select(*keys, cell.alias("cell"), F.when(total, F.col("n")).otherwise(F.col("n") * F.col("s")).alias("n"), "x", "c")
    added = placed.groupBy(*keys, "cell").agg(F.sum("n").cast("bigint").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))
    return added.where("cell < 0 or n <> 0 or x <> 0 or c <> 0")


def subtract(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The difference of two tables of sketches."""
    return difference(left.withColumn("s", F.lit(1)).unionByName(right.withColumn("s", F.lit(-1))), keys)


def peel(difference: DataFrame, keys: list[str], cells: int, rounds: int = ROUNDS) -> DataFrame:
    """(keys, cell, n, digest, side): recovered digests, left-over cells and the two counts.

    Recovered rows have side 1 (left only) or -1 (right only), left-over cells side 0 and
    counts side 2. A round takes the pure cells of one part; a digest has one cell there, so it is found once.
    """
    width = cells // PARTS
    state = difference.select(*keys, "cell", "n", "x", "c", F.when(F.col("cell") < 0, 2).otherwise(0).alias("side"))
    for r in range(rounds):
        part = r % PARTS
        pure = (F.col("side") == 0) & F.col("cell").between(part * width, part * width + width - 1) & (F.abs("n") == 1) & (F.col("c") == check_of(F.col("x")))
        same = F.struct("cell", "n", "x", "c", F.col("side").alias("side"))
        others = [F.struct(cell_of(F.col("x"), F.lit(p), cells).alias("cell"), (-F.col("n")).alias("n"), F.col("x").alias("x"), F.col("c").alias("c"), F.lit(0).alias("side")) for p in range(PARTS) if p != part]
        found = F.struct(F.lit(FOUND).alias("cell"), F.col("n").alias("n"), F.col("x").alias("x"), F.col("c").alias("c"), F.col("n").cast("int").alias("side"))
        emitted = state.select(*keys, F.inline(F.when(pure, F.array(found, *others)).otherwise(F.array(same))))
        # recovered digests are kept apart from cells by their own value
        kept = F.when(F.col("side") == 0, F.lit(0).cast("bigint")).otherwise(F.col("x"))
        grouped = emitted.groupBy(*keys, "cell", "side", kept.alias("own")).agg(F.sum("n").cast("bigint").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))
        state = grouped.where("side <> 0 or n <> 0 or x <> 0 or c <> 0").drop("own")
    return state.select(*keys, "cell", "n", F.when(F.abs("side") == 1, F.col("x")).alias("digest"), "side")


def compare(difference: DataFrame, keys: list[str], cells: int, rounds: int = ROUNDS) -> DataFrame:
    """(keys, left, right, likeness, _apart, _ok) by peeling: the digests that one version alone has, and what they share over all.

    Not ``_ok``: cells are left over, or the digests do not fit the counts, which are ``_apart`` by so much.
    """
    count = lambda cell: F.sum(F.when(F.col("cell") == cell, F.col("n")).otherwise(0))
    only = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("digest")))
    found = peel(difference, keys, cells, rounds).groupBy(*keys).agg(count(TOTAL).alias("_a"), count(TOTAL - 1).alias("_b"), only(1).alias("left"), only(-1).alias("right"), F.count_if(F.col("side") == 0).alias("_over"))
    shared, total = F.col("_a") - F.size("left"), F.col("_a") + F.size("right")
    ok = (F.col("_over") == 0) & (shared >= 0) & (F.col("_b") - F.size("right") == shared)
    return found.select(*keys, "left", "right", F.when(total > 0, shared / total).otherwise(F.lit(1.0)).alias("likeness"), F.abs(F.col("_a") - F.col("_b")).alias("_apart"), ok.alias("_ok"))


def likeness(pairs: DataFrame, keys: list[str], cells: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """(keys, left, right, likeness) of rows (keys, a, b) of digest arrays; sketches grow until peeling succeeds.

    Pairs must be unique by ``keys``; the first key decides the partition.
    """
    spark = pairs.sparkSession
    done, todo = [], materialize(pairs, "pairs")
    while True:
        # a difference is at least that of the sizes, and no sketch gives back more digests than cells
        apart = F.abs(F.size("a") - F.size("b")) > cells
        ready = todo.where(~apart).repartition(partitions(spark), keys[0])
        versions = ready.select(*keys, F.inline(F.array(F.struct(F.lit(1).alias("s"), F.col("a").alias("d")), F.struct(F.lit(-1).alias("s"), F.col("b").alias("d")))))
        sketches = sketch_cells(versions.select(*keys, "s", F.explode_outer("d").alias("digest")), [*keys, "s"], cells)
        result = materialize(compare(difference(sketches, keys), keys, cells, rounds), "likeness")
        done.append(result.where("_ok").select(*keys, "left", "right", "likeness"))
        again = materialize(todo.join(result.where("not _ok").select(*keys), keys, "left_semi").unionByName(todo.where(apart)), "pairs")
        discard(todo)
        if again.isEmpty():
            return reduce(DataFrame.unionByName, done)
        cells, todo = cells * 4, again


def fingerprint_text(digests: Column, cells: int = CELLS) -> Column:
    """The non-empty cells of the sketch of an array of digests, as text: cell, count, xor of digests and of check values.

    One row's own expression: a sketch to be kept or printed needs no grouping, only those that are subtracted do.
    """
    width = cells // PARTS
    known = F.transform(digests, lambda x: F.struct(x.alias("x"), check_of(x).alias("c"), *[cell_of(x, F.lit(p), cells).alias(f"p{p}") for p in range(PARTS)]))
    xor = lambda held, c: F.lower(F.hex(F.aggregate(held, F.lit(0).cast("bigint"), lambda a, e: a.bitwiseXOR(e[c]))))

    def of_part(k: Column, p: int) -> Column:
        members = F.transform(F.sequence(F.lit(p * width), F.lit((p + 1) * width - 1)), lambda j: F.struct(j.alias("cell"), F.filter(k, lambda e: e[f"p{p}"] == j).alias("m")))
        return F.transform(F.filter(members, lambda z: F.size(z["m"]) > 0), lambda z: F.concat_ws(":", z["cell"], F.size(z["m"]), xor(z["m"], "x"), xor(z["m"], "c")))

    # bound to a variable, so that a digest's cells are found once
    return F.transform(F.array(known), lambda k: F.array_join(F.concat(*[of_part(k, p) for p in range(PARTS)]), " "))[0]


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, row, end, doc_id, text, next_text): each document with the next by doc_id, the last with the first.

    Texts are dealt out once, by ranges of doc_id. The first text of each range, which the last
    row of the range before needs, is fetched by its id and dealt out with that range, behind its
    rows, as one with ``end`` 1: as many rows as ranges.
    """
    spark = docs.sparkSession
    n = partitions(spark) * 4
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bucket = range_bucket(F.col("doc_id"), quantile_bounds(rows, F.col("doc_id"), n)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    firsts = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"))).alias("m")).select("bucket", F.col("m.doc_id").alias("first_id"))
    ring = Window.orderBy("bucket")  # a row per range
    following = firsts.select("bucket", F.coalesce(F.lead(F.struct("first_id")).over(ring), F.first(F.struct("first_id")).over(ring))["first_id"].alias("first_id"))
    wanted = following.select("first_id").distinct()
    heads = rows.join(F.broadcast(wanted), rows["doc_id"].eqNullSafe(wanted["first_id"])).groupBy("first_id").agg(F.min("text").alias("head"))
    # each range also gets the first text of the next one, after its own rows
    ends = following.join(heads, following["first_id"].eqNullSafe(heads["first_id"])).select("bucket", F.lit(1).alias("end"), F.lit(None).cast("bigint").alias("doc_id"), F.col("head").alias("text"))
    order = Window.partitionBy("bucket").orderBy("end", F.col("doc_id").asc_nulls_first(), "text")
    full = rows.select("bucket", F.lit(0).alias("end"), "doc_id", "text").unionByName(ends).repartition(partitions(spark), "bucket")
    placed = full.withColumn("row", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    return placed.select("bucket", "row", "end", "doc_id", "text", "next_text")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by as many first ones of the following text."""
    n = F.char_length(text)
    m = F.floor(n / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - m), F.substr(following, F.lit(1), m))


def edit_fingerprints(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, recovered_edited_sha256, recovered_next_sha256).

    The last two are of the digests, as ascending decimals joined by commas, that the text
    alone has, a bar, and those that the edited text or the next document alone has.
    """
    spark = docs.sparkSession
    keys, pair = ["bucket", "row"], ["bucket", "row", "kind"]
    ringed = with_next(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    facts = [F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")]
    changed = F.when(F.col("end") == 0, paragraph_digests(F.col("edited")))
    table = materialize(ringed.select(*keys, "end", "doc_id", *facts, paragraph_digests(F.col("text")).alias("own"), changed.alias("changed")), "digests")

    # a sketch per version; a text's own goes to its two comparisons and to that of the document before
    held = table.repartition(partitions(spark), "bucket")
    versions = held.select(*keys, "end", F.inline(F.array(F.struct(F.lit(0).alias("v"), F.col("own").alias("d")), F.struct(F.lit(1).alias("v"), F.col("changed").alias("d"))))).where("end = 0 or v = 0")
    sketches = sketch_cells(versions.select(*keys, "end", "v", F.explode_outer("d").alias("digest")), [*keys, "end", "v"], cells)
    to = lambda row, kind, s: F.struct(row.alias("row"), F.lit(kind).alias("kind"), F.lit(s).alias("s"))
    row, none = F.col("row"), F.array().cast("array<struct<row:int,kind:int,s:int>>")
    uses = F.concat(F.when(F.col("end") == 0, F.array(to(row, EDITED, 1), to(row, NEXT, 1))).otherwise(none), F.when(row > 1, F.array(to(row - 1, NEXT, -1))).otherwise(none))
    signed = sketches.select("bucket", "cell", "n", "x", "c", F.inline(F.when(F.col("v") == 0, uses).otherwise(F.array(to(row, EDITED, -1)))))
    first = materialize(compare(difference(signed, pair), pair, cells), "likeness")
    near = first.where("_ok").select(*pair, "left", "right", "likeness")
    failed = first.where("not _ok").groupBy(*keys).agg(F.collect_set("kind").alias("_kinds"))
    if not failed.isEmpty():
        following = F.lead("own").over(Window.partitionBy("bucket").orderBy("row")).alias("following")
        both = table.select(*keys, "own", "changed", following).join(failed, keys)
        sides = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col("own").alias("a"), F.col(other).alias("b")) for kind, other in ((EDITED, "changed"), (NEXT, "following"))])
        wanted = both.select(*keys, F.inline(F.filter(sides, lambda x: F.array_contains("_kinds", x["kind"]))))
        near = near.unionByName(likeness(wanted, pair, cells * 4))

    told = F.sha2(F.concat_ws("|", *[F.array_join(F.sort_array(c), ",") for c in ("left", "right")]).cast("binary"), 256)
    short = near.select(*pair, "likeness", told.alias("told"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    n = partitions(spark)  # as many tasks as were asked for: what is small to shuffle is not small to print
    wide = short.repartition(n, *keys).groupBy(*keys).agg(of(EDITED, "likeness").alias("near_edited"), of(NEXT, "likeness").alias("near_next"), of(EDITED, "told").alias("recovered_edited_sha256"), of(NEXT, "told").alias("recovered_next_sha256"))
    printed = [fingerprint_text(F.col(c), cells).alias(name) for c, name in (("own", "fingerprint"), ("changed", "edited_fingerprint"))]
    return table.where("end = 0").repartition(n, *keys).join(wide, keys).select("doc_id", "n_chars", "edited_sha256", *printed, *wide.columns[2:])
