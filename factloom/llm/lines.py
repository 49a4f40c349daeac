"""Operator 6: line deduplication by winnowing over line hashes (DataFrame functions only).

A document is a sequence of lines; lines without words only stand between others. A run of
consecutive lines of `min_words` words or more in all, with words in its first and its last line,
is a match if it occurs twice. Winnowing finds matches from few positions: every shortest window of
lines that reaches `min_words` words, counted on from its first line or back from its last, selects
the line of its least hash (the rightmost of equals), so equal windows select the same line
wherever they occur and any match holds a selected line at the same place in both occurrences.
Selected positions are joined by their line's hash, and those that stand alone are dismissed.
Around the others matches are extended both ways to the windows that selected the position; those
that occur earlier as well make up, put together, the later repeated runs, which are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard
from .common import WORD, materialize, nested, read_table, unnested

MIN_WORDS = 8


def _line_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, ls, hs, h2s) of texts with words: of the lines with words (index, hash, words), of all lines two hashes."""
    text = F.col(text_col).cast("string")
    lines = docs.where(text.isNotNull() & text.rlike(WORD)).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines"))
    every = F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit("second"), x).alias("h2"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    lines = lines.select("id", "th", every.alias("every"))
    return lines.select("id", "th", F.filter("every", lambda x: x["w"] > 0).alias("ls"), F.transform("every", lambda x: x["h"]).alias("hs"), F.transform("every", lambda x: x["h2"]).alias("h2s"))


def _windows(min_words: int) -> tuple[Column, Column]:
    """`ws`, the words of `ls`, and the shortest windows (first, last) over it that reach `min_words`, from both ends.

    A window starts and ends with a line that has words, so it holds at most `min_words` of them.
    Two long lines with wordless lines between them take a window of both, so that a match of
    both covers those as well.
    """

    def reach(words: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
        more = lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"))
        return F.aggregate(words, start, lambda a, x: F.when(a["sum"] >= min_words, a).otherwise(more(a, x)), lambda a: F.when(a["sum"] >= min_words, a["n"]))

    def pair(first: Column, last: Column) -> Column:
        return F.when(first.isNotNull() & last.isNotNull(), F.struct(first.alias("first"), last.alias("last")))

    words = F.transform("ls", lambda x: x["w"])
    every = F.sequence(F.lit(0), F.size("ls") - 1)

    def forward(k: Column) -> Column:
        return pair(k, k + reach(F.slice("ws", k + 1, F.lit(min_words))) - 1)

    def backward(k: Column) -> Column:
        n = F.least(k + 1, F.lit(min_words))
        return pair(k - reach(F.reverse(F.slice("ws", k + 2 - n, n))) + 1, k)

    def gap(k: Column) -> Column:
        apart = F.get("ls", k + 1)["i"] > F.get("ls", k)["i"] + 1
        return F.when(apart & (F.get("ws", k) >= min_words) & (F.get("ws", k + 1) >= min_words), pair(k, k + 1))

    found = F.array_distinct(F.array_compact(F.concat(F.transform(every, forward), F.transform(every, backward), F.transform(every, gap))))
    return words.alias("ws"), found.alias("windows")


def _selected(window: Column) -> Column:
    """The place in `ls` of the least hash of a window, the rightmost of equals."""
    part = F.slice("ls", window["first"] + 1, window["last"] - window["first"] + 1)
    return F.array_max(F.transform(part, lambda x, i: F.struct(F.bitwise_not(x["h"]).alias("h"), (window["first"] + i).alias("at"))))["at"]


def winnowed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, at, fp, first, last, g1, g2): every window's selected position and what surrounds it.

    th is the hash of the text; (id, th) names a document. at is the selected line and fp its
    hash; the window reaches from line `first` to `last`, and g1, g2 are hashes of all of it.
    """
    words, windows = _windows(min_words)
    base = _line_hashes(docs, id_col, text_col).select("*", words).select("*", windows)

    def around(w: Column) -> Column:
        chosen = F.get("ls", _selected(w))
        first, last = F.get("ls", w["first"])["i"], F.get("ls", w["last"])["i"]
        both = [F.xxhash64(F.slice(c, first + 1, last - first + 1)).alias(g) for c, g in (("hs", "g1"), ("h2s", "g2"))]
        return F.struct(chosen["i"].alias("at"), chosen["h"].alias("fp"), first.alias("first"), last.alias("last"), *both)

    return base.select("id", "th", F.explode(F.transform("windows", around)).alias("x")).select("id", "th", "x.*")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, first, last): the later occurrences of repeated windows of lines, ends included."""
    spots = materialize(winnowed(docs, id_col, text_col, min_words), "lines-spots")
    # Positions joined by fingerprint: a line that only one place selects has no match around it.
    place = F.struct("id", "th", "at")
    shared = spots.groupBy("fp").agg(F.min(place).alias("low"), F.max(place).alias("high")).where(~F.col("low").eqNullSafe(F.col("high"))).select("fp")
    shared = materialize(shared, "lines-shared")
    live = spots.join(shared, "fp", "left_semi").select("id", "th", "first", "last", "g1", "g2")
    live = materialize(live, "lines-live")
    discard(spots, shared)
    one = F.struct("id", "th", "first", "last")
    earliest = live.groupBy("g1", "g2").agg(F.min(one).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    earliest = materialize(earliest, "lines-earliest")
    later = live.join(earliest, ["g1", "g2"]).where(~one.eqNullSafe(F.col("earliest")))
    later = materialize(later.select("id", "th", "first", "last"), "lines-later")
    discard(live, earliest)
    return later


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(row, lines, gone, kept): every row of `docs`, whole, its lines, the numbers of those to delete, and the text left.

    The text is in `row` alone where rows are shuffled.
    """
    later = repeated_runs(docs, id_col, text_col, min_words)
    hits = later.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    hits = materialize(hits.select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), "runs"), "lines-hits")
    discard(later)
    rows = nested(docs)
    whole = F.col(f"row.`{text_col}`").cast("string")
    out = rows.join(hits, F.col(f"row.`{id_col}`").eqNullSafe(F.col("hit_id")) & (F.xxhash64(whole) == F.col("hit_th")), "left")
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))))
    out = out.select("row", F.split(whole, "\n", -1).alias("lines"), F.when(F.col("runs").isNotNull(), gone).alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return out.select("row", "lines", "gone", left.alias("kept"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, counts: tuple[str, str] | None = None) -> DataFrame:
    """`docs` with later repeated runs of lines deleted; `counts` names columns for lines and removed lines.

    A line goes if it is part of a run of consecutive lines, one or more, with `min_words` words
    or more in all and words in its first and its last line, that also starts earlier: in a
    smaller id (null first; rows that repeat an id come in order of their text's hash), or
    further up in the same text. Rows equal in id and text are one document and get the same
    result. Null texts stay null and have no lines. A document that loses every line keeps an
    empty text. Other columns stay, whatever their names; those that `counts` names are replaced.
    """
    out, more = _without_repeats(docs, id_col, text_col, min_words), {}
    if counts:
        more[counts[0]] = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("bigint")
        more[counts[1]] = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("bigint")
    return unnested(out, docs, {text_col: F.col("kept"), **more})


def keep_first_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` without later repeated runs of lines; documents that lose lines and have no word left go."""
    out = _without_repeats(docs, id_col, text_col, min_words)
    return unnested(out.where(F.col("gone").isNull() | F.col("kept").rlike(WORD)), docs, {text_col: F.col("kept")})


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeated_lines(docs, counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


# Windows are found here from running word counts: from a line with words on to the first that
# makes up 8 words, back from it likewise, and two long lines that only wordless ones part.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, s, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS s, unnest(ls) AS line FROM d)),
w AS (
  SELECT doc_id, s, n, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS upto,
         lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS s2, lead(n) OVER (PARTITION BY doc_id ORDER BY s) AS n2
  FROM l WHERE n > 0),
win AS (
  SELECT a.doc_id, a.s AS f, b.s AS t FROM w a ASOF JOIN w b ON a.doc_id = b.doc_id AND a.upto - a.n + 8 <= b.upto
  UNION
  SELECT b.doc_id, a.s, b.s FROM w b ASOF JOIN w a ON b.doc_id = a.doc_id AND b.upto - 8 >= a.upto - a.n
  UNION
  SELECT doc_id, s, s2 FROM w WHERE s2 > s + 1 AND n >= 8 AND n2 >= 8),
g AS (
  SELECT win.doc_id, f, t, row_number() OVER (PARTITION BY ls[f + 1 : t + 1] ORDER BY win.doc_id, f, t) AS k
  FROM win JOIN d ON win.doc_id = d.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(f, t)) AS s FROM g WHERE k > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.s) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.s) FILTER (WHERE gone.s IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.s = gone.s GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
