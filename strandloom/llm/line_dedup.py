"""Near-duplicate lines by a deletion-neighbourhood join.

A line is dropped if an earlier line is within ``max_edits`` (one character
inserted, deleted or replaced) of it; the earliest such line is the one kept in
its place.  Lines are compared without surrounding blanks, tabs and carriage
returns; those of fewer than ``min_chars`` characters are left alone.  Earlier
means a smaller (document id, line number), null ids last.

Two lines within one edit have equal variants: the lines themselves or the
lines without one character.  Emitting all of them costs as many rows as the
text has characters, so variants that cannot match are ruled out first, without
loss, by pigeonhole.  Split the shorter line into m segments: the edit lies in
one of them, so everything before and everything after it is equal in both.

1. The texts are split once into a slim table of places with a 128-bit hash of
   the line and hashes of its halves.  Equal lines become one (its first
   occurrence); from here on, a line counts once however often it stands.
2. With m = 2: only lines that share a half with another line go on.
3. With m = 8: of those, whose text is now read, only lines that share all but
   an eighth with another.
4. For these, the variants within that eighth are emitted as hashed keys, lines
   with equal variants are joined, and the edit distance is verified.

All of it is JVM expressions over DataFrames; groups are never collected.  What
a group is asked for is a minimum or maximum, which tasks reduce before anything
moves, so a line that every document has is no more work than another.

Cases: null and empty texts have no lines.  Repeated rows have the same (id,
line number) and count as one; of two texts with one id, ties in position go by
the line's hash.  An empty table gives an empty result.  Lines may be of any
length.  Columns other than id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plan import cut, small

BLANKS = " \t\r"
SEGMENTS = 8


def lines_of(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(i, n, line) of all lines that take part; n counts a text's lines from 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "raw"))
    return rows.select("i", "n", F.btrim("raw", F.lit(BLANKS)).alias("line")).where(F.char_length("line") >= min_chars)


def _h1() -> F.Column:
    return F.xxhash64("line")


def _h2() -> F.Column:
    return F.xxhash64(F.lit(7), F.col("line"))


def _halves() -> F.Column:
    """The hashes of the halves that a line may share with one an edit away, that one being as long, longer or shorter.

    With n characters and the shorter line's half rounded down, they are: the
    first n/2; the first n/2 - 1 of an even n, or the last n/2 of an odd one;
    and the last n/2, rounded up.
    """
    n, c = F.char_length("line"), F.expr("char_length(line) div 2").cast("int")
    first = lambda k: F.xxhash64(F.lit(0), k, F.substr("line", F.lit(1), k))
    last = lambda k: F.xxhash64(F.lit(1), k, F.substr(F.col("line"), n - k + 1))
    return F.array(first(c), F.when(n % 2 == 0, first(c - 1)).otherwise(last(c)), last(n - c))


def _contexts(line: F.Column, segments: int = SEGMENTS) -> F.Column:
    """(before, after, key) for each segment that an edit may lie in: the lengths of what is equal around it and its hash."""
    size = F.char_length(line)

    def one(m: F.Column, j: F.Column) -> F.Column:
        before = F.floor(m * j / segments).cast("int")
        after = (m - F.floor(m * (j + 1) / segments)).cast("int")
        key = F.xxhash64(before, after, F.substr(line, F.lit(1), before), F.substr(line, size - after + 1, after))
        return F.struct(before.alias("before"), after.alias("after"), key.alias("key"))

    each = F.sequence(F.lit(0), F.lit(2 * segments - 1))
    return F.array_distinct(F.transform(each, lambda x: one(size - F.floor(x / segments), x % segments)))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of a ``key`` that rows with another ``h1`` have, too."""
    ends = rows.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    return rows.join(ends.where("lo <> hi").select("key"), "key", "left_semi")


def _near(lines: DataFrame, first: DataFrame) -> DataFrame:
    """(h1, h2, near): the earliest line within one edit of a distinct line (h1, h2, head, keys), if it is earlier."""
    halves = cut(first.select("h1", "h2", F.explode("keys").alias("key")))
    going = cut(_shared(halves).select("h1", "h2").distinct())
    keyed = lines.select(_h1().alias("h1"), _h2().alias("h2"), "line")
    texts = cut(keyed.join(small(going), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line")))
    inner = cut(texts.select("h1", "h2", F.explode(_contexts(F.col("line"))).alias("c")).select("h1", "h2", F.col("c.before").alias("before"), F.col("c.after").alias("after"), F.col("c.key").alias("key")))
    close = _shared(inner).join(texts, ["h1", "h2"])
    middle = F.substr("line", F.col("before") + 1, F.char_length("line") - F.col("before") - F.col("after"))
    close = close.select("h1", "h2", "key", middle.alias("gap"))
    # the gap whole, and without each of its characters
    without = F.transform(F.sequence(F.lit(0), F.char_length("gap")), lambda x: F.xxhash64(F.col("key"), F.when(x == 0, F.col("gap")).otherwise(F.concat(F.substr(F.col("gap"), F.lit(1), x - 1), F.substr(F.col("gap"), x + 1)))))
    variants = close.select("h1", "h2", F.explode(F.array_distinct(without)).alias("variant"))
    placed = variants.join(first.select("h1", "h2", "head"), ["h1", "h2"])
    a = placed.select("variant", F.col("h1").alias("h1"), F.col("h2").alias("h2"), F.col("head").alias("head"))
    b = placed.select("variant", F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("head").alias("near"))
    pairs = a.join(b, "variant").where("near < head").select("h1", "h2", "g1", "g2", "near").distinct()
    other = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other"))
    both = pairs.join(texts, ["h1", "h2"]).join(other, ["g1", "g2"])
    return both.where(F.levenshtein("line", "other", 1) == 1).groupBy("h1", "h2").agg(F.min("near").alias("near"))


def duplicate_lines(docs: DataFrame, min_chars: int = 16, max_edits: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, keep_doc_id, keep_line_no, edits): each line to drop, and the earliest line within the bound."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = lines_of(docs, min_chars, id_col, text_col)
    place = F.struct(F.col("i").isNull().alias("z"), F.col("i").alias("i"), F.col("n").alias("n"), F.col("h1").alias("h"))
    slim = cut(lines.select("i", "n", _h1().alias("h1"), _h2().alias("h2"), *([_halves().alias("keys")] if max_edits else [])))
    keys = [F.first("keys").alias("keys")] if max_edits else []
    first = cut(slim.groupBy("h1", "h2").agg(F.min(place).alias("head"), F.max(place).alias("last"), *keys))
    if max_edits:
        first = first.join(_near(lines, first), ["h1", "h2"], "left")
    else:
        first = first.withColumn("near", F.lit(None).cast(first.schema["head"].dataType))
    # lines that stand at one place and have no neighbour are left alone
    some = small(cut(first.where("near IS NOT NULL OR head <> last").select("h1", "h2", "head", "near")))
    seen = slim.select("i", "n", "h1", "h2").join(some, ["h1", "h2"]).withColumn("place", place)
    kept = F.coalesce("near", "head")
    out = seen.where("near IS NOT NULL OR place <> head").select("i", "n", "h1", "h2", kept.alias("kept"), F.col("near").isNull().alias("same")).distinct()
    return out.select(F.col("i").alias("doc_id"), F.col("n").alias("line_no"), F.col("kept.i").alias("keep_doc_id"), F.col("kept.n").alias("keep_line_no"), F.when(F.col("same"), 0).otherwise(1).alias("edits"))


ORACLE = """
WITH lines AS (
  SELECT DISTINCT doc_id, n - 1 AS line_no, trim(raw, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
  WHERE length(trim(raw, ' ' || chr(9) || chr(13))) >= 16),
heads AS (SELECT line, min(struct_pack(i := doc_id, n := line_no)) AS head FROM lines GROUP BY line),
cuts AS (SELECT line, head, p, left(line, p - 1) || substr(line, p + 1) AS v
  FROM (SELECT line, head, unnest(range(1, length(line) + 1)) AS p FROM heads)),
pairs AS (
  SELECT a.line, b.head AS near FROM cuts a JOIN cuts b ON a.v = b.v AND a.p = b.p AND b.head < a.head
  UNION ALL SELECT a.line, b.head FROM cuts a JOIN heads b ON a.v = b.line AND b.head < a.head
  UNION ALL SELECT a.line, b.head FROM heads a JOIN cuts b ON a.line = b.v AND b.head < a.head),
nearest AS (SELECT line, min(near) AS near FROM pairs GROUP BY line)
SELECT l.doc_id, CAST(l.line_no AS INTEGER) AS line_no, CAST(coalesce(near, head).i AS BIGINT) AS keep_doc_id, CAST(coalesce(near, head).n AS INTEGER) AS keep_line_no,
  CAST(CASE WHEN near IS NULL THEN 0 ELSE 1 END AS INTEGER) AS edits
FROM lines l JOIN heads USING (line) LEFT JOIN nearest USING (line)
WHERE near IS NOT NULL OR struct_pack(i := l.doc_id, n := l.line_no) <> head
"""
