"""Optional text and vector indexes over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def text_index(live: DataFrame, attribute: str) -> DataFrame:
    """(term, e): lower-cased words of a text attribute.

    A text's words are made distinct in its row. Only entities with several texts can repeat a pair
    then, and only their pairs are dealt.
    """
    texts = live.where(F.col("a") == attribute).select("e", "v_str")
    several = texts.groupBy("e").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("e").alias("_e"))
    several = materialize(several, "text-several")
    words = F.array_distinct(F.split(F.lower("v_str"), "[^\\p{L}\\p{N}]+"))

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select("e", F.explode(words).alias("term")).where("term <> ''").select("term", "e")

    if several.isEmpty():
        return pairs(texts)
    same = texts.e.eqNullSafe(several["_e"])
    return pairs(texts.join(several, same, "left_anti")).unionByName(pairs(texts.join(several, same, "left_semi")).distinct())


def text_search(index: DataFrame, terms: list[str]) -> DataFrame:
    """Entities that have all of the terms."""
    terms = sorted({t.lower() for t in terms})
    hits = index.where(F.col("term").isin(terms)).groupBy("e").agg(F.count_distinct("term").alias("n"))
    return hits.where(F.col("n") == len(terms)).select("e")


def text_scan(live: DataFrame, attribute: str, terms: list[str]) -> DataFrame:
    """The same without an index."""
    return text_search(text_index(live, attribute), terms)


def vector_search(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the k vectors with the largest dot product; ties to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.aggregate(F.zip_with(F.col(vector_col), q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return vectors.select(F.col(id_col), score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)
