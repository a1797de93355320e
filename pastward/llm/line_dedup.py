"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only.

A line with a word goes if an earlier line of the corpus, by (doc_id, line number), is at most one insertion, deletion or
replacement of a code point away, equal lines included. With ``min_chars`` lines of fewer code points are compared for equality only.
An empty table gives an empty one; a line of any length is compared as a whole.

Equal lines are found by hash. For the rest a line is cut into parts; one edit falls into one part, and then
everything outside this part, the *frame*, is the same in both lines. Only lines that share a frame with another line
emit their deletion neighbourhood: the part, and the part without each of its code points, hashed together with the
frame. Two lines of one length match where the same place is left out of both; a line matches one that is longer by one
where the longer line's variant is the shorter line's part. Either way all that share a key are within the bound of
the one that counts, so that the earliest of a key is found by a minimum, and no pairs inside a key are formed. The
edit distance of each line to the line found is verified on the texts. A bound of two edits would need a
quadratic number of variants and isn't offered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.llm.shared import SPACES, Scratch, bit_filter

MIN_CHARS = 1
#: A part holds about so many code points at most; two parts at least.
PART_CHARS = 256
_PLACE = "struct<doc_id:bigint,line_no:int,row_hash:bigint>"


def _parts(base: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(base / PART_CHARS).cast("int"))


def _frame(line: Column, length: Column, longer: int, j: Column) -> tuple[Column, Column, Column]:
    """(hash of the frame of part ``j``, start, length of the part); ``longer``: 1 to pair with lines shorter by one."""
    base = length - longer
    parts = _parts(base)
    start = F.floor(j * base / parts).cast("int")
    rest = base - F.floor((j + 1) * base / parts).cast("int")
    key = F.xxhash64(base, j, F.substring(line, F.lit(1), start), F.substring(line, length - rest + 1, rest))
    return key, start, length - start - rest


def _frames(line: Column, length: Column) -> Column:
    """(longer, part, hash) of all frames of a line."""

    def of(longer: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), _parts(length - longer) - 1),
            lambda j: F.struct(F.lit(longer).alias("longer"), j.alias("part"), _frame(line, length, longer, j)[0].alias("frame")),
        )

    return F.concat(of(0), of(1))


def _variants(line: Column, length: Column, frame: Column) -> Column:
    """Hashed keys of a line's part inside a frame.

    kind 0: same place left out of both; kind 1: part whole; kind 2: part without a code point of a line longer by one.
    """

    def of(longer: int) -> Column:
        _, start, size = _frame(line, length, longer, frame["part"])

        def without(i: Column) -> Column:
            return F.concat(F.substring(line, start + 1, i - 1), F.substring(line, start + i + 1, size - i))

        def key(kind: int, *values: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(min(kind, 1)), frame["frame"], *values).alias("key"))

        places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        if longer:
            return F.transform(places, lambda i: key(2, without(i)))
        whole = F.array(key(1, F.substring(line, start + 1, size)))
        return F.concat(F.transform(places, lambda i: key(0, i, without(i))), whole)

    return F.when(frame["longer"] == 1, of(1)).otherwise(of(0))


def _line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_hash, line_no, line, size, a, b) of the lines with a word; a, b: 128 bits of the line's hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    rows = rows.filter(F.btrim("line", F.lit(SPACES)) != "")
    return rows.select("*", F.length("line").alias("size"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def _earliest_near(docs: DataFrame, lines: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(a, b, near): the place of the earliest other line within the bound, for lines that have one before them."""
    frames = lines.select("a", "b", "first", F.explode("frames").alias("f")).select("a", "b", "first", "f.*")
    shared = frames.groupBy("frame").agg(F.min("a").alias("low"), F.max("a").alias("high")).filter("low <> high").select("frame")
    chosen = frames.join(shared, "frame", "left_semi").groupBy("a", "b").agg(F.min("first").alias("first"), F.collect_set(F.struct("longer", "part", "frame")).alias("frames"))
    chosen = scratch.keep(chosen, "chosen")
    texts = bit_filter(chosen.select("a"), _line_rows(docs, id_col, text_col).select("a", "b", "line"), "a")
    texts = texts.groupBy("a", "b").agg(F.first("line").alias("line"))
    chosen = scratch.keep(chosen.join(texts, ["a", "b"]), "texts")

    keys = chosen.select("a", "b", "first", F.explode("frames").alias("f"), F.length("line").alias("size"), "line")
    keys = keys.select("a", "b", "first", F.explode(_variants(F.col("line"), F.col("size"), F.col("f"))).alias("v")).select("a", "b", "first", "v.*")
    keys = scratch.keep(keys, "keys")
    place = F.struct("first", "a", "b")
    best = keys.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, place)).alias(f"best{k}") for k in range(3)], F.count_if(F.col("kind") == 0).alias("same"))
    best = best.filter("same > 1 OR best1 IS NOT NULL AND best2 IS NOT NULL").drop("same")
    other = F.when(F.col("kind") == 0, F.col("best0")).when(F.col("kind") == 1, F.col("best2")).otherwise(F.col("best1"))
    found = keys.join(best, "key").withColumn("other", other).filter(F.col("other.first") < F.col("first"))
    found = found.select("a", "b", F.col("other.first").alias("near"), F.col("other.a").alias("oa"), F.col("other.b").alias("ob")).distinct()

    line = chosen.select("a", "b", "line")
    pairs = found.join(line, ["a", "b"]).join(line.select(F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("line").alias("other")), ["oa", "ob"])
    return pairs.filter(F.levenshtein("line", "other", 1).between(0, 1)).groupBy("a", "b").agg(F.min("near").alias("near"))


def removed_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_hash, removed): line numbers to remove, from 0; rows without any are absent."""
    occurrence = F.struct("doc_id", "line_no", "row_hash").cast(_PLACE)
    lines = _line_rows(docs, id_col, text_col)
    frames = F.when(F.col("size") >= min_chars, _frames(F.col("line"), F.col("size"))).alias("frames")
    lines = scratch.keep(lines.select("a", "b", occurrence.alias("place"), frames), "lines")
    classes = lines.groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    classes = scratch.keep(classes, "classes")
    near = _earliest_near(docs, lines.withColumnRenamed("place", "first"), scratch, id_col, text_col)
    limits = classes.join(near, ["a", "b"], "left").filter("copies > 1 OR near IS NOT NULL").select("a", "b", F.least("first", F.coalesce("near", "first")).alias("limit"))
    gone = lines.select("a", "b", "place").join(limits, ["a", "b"]).filter(F.col("place") > F.col("limit"))
    return gone.groupBy("place.doc_id", "place.row_hash").agg(F.collect_set("place.line_no").alias("removed"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs``, ``text_col`` without the lines that go, and ``n_lines``, ``n_removed`` (long).

    Null texts stay null and have no lines; rows that share id and text are one document for the order of lines,
    as are rows with a null id, which come first. The rest of the text keeps its line breaks.
    """
    scratch = Scratch(docs.sparkSession, "line_dedup")
    gone = scratch.keep(removed_lines(docs, scratch, id_col, text_col, min_chars), "removed")
    scratch.drop("lines", "classes", "chosen", "texts", "keys")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(text_col).alias("_text"))
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("row_hash").alias("_gone_hash"), "removed")
    rows = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_hash") == F.col("_gone_hash")), "left")
    lines = F.split("_text", "\n", -1)
    rows = rows.withColumn("n_lines", F.coalesce(F.when(F.col("_text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_removed", F.coalesce(F.size("removed"), F.lit(0)).cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
    text = F.when(F.col("removed").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = [text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in columns]
    return rows.select(*out, "n_lines", "n_removed")


#: One edit in code points; ``levenshtein`` counts bytes there.
_ONE_EDIT = """y.n BETWEEN x.n - 1 AND x.n + 1 AND y.first < x.first AND levenshtein(x.line, y.line) BETWEEN 1 AND 4 AND len(list_filter(range(greatest(x.n, y.n)), lambda i:
  CASE WHEN x.n = y.n THEN left(x.line, i) || substr(x.line, i + 2) = left(y.line, i) || substr(y.line, i + 2)
  WHEN x.n > y.n THEN left(x.line, i) || substr(x.line, i + 2) = y.line ELSE left(y.line, i) || substr(y.line, i + 2) = x.line END)) > 0"""
#: The same result for DuckDB, over the view ``documents`` (ids not null and distinct).
SQL = f"""
WITH lines AS (
 SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
long AS (SELECT * FROM lines WHERE translate(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> ''),
classes AS MATERIALIZED (SELECT line, length(line) AS n, min((doc_id, line_no)) AS first FROM long GROUP BY line),
pairs AS (
 SELECT x.line, y.first FROM classes x JOIN classes y ON left(x.line, 9) = left(y.line, 9) AND {_ONE_EDIT}
 UNION ALL
 SELECT x.line, y.first FROM classes x JOIN classes y ON right(x.line, 9) = right(y.line, 9) AND {_ONE_EDIT}
 UNION ALL
 SELECT x.line, y.first FROM (SELECT * FROM classes WHERE n <= 20) x JOIN (SELECT * FROM classes WHERE n <= 20) y ON {_ONE_EDIT}),
limits AS (SELECT line, min(first) AS place FROM (SELECT line, first FROM classes UNION ALL SELECT line, first FROM pairs) GROUP BY line),
judged AS (SELECT l.doc_id, l.line_no, l.line, coalesce((l.doc_id, l.line_no) > m.place, false) AS gone FROM lines l LEFT JOIN limits m ON l.line = m.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
 coalesce(md5(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone)), md5('')) AS kept_md5
FROM judged GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
