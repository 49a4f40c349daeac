"""Operator 7: personal data by patterns and by information-theoretic sanitisation (DataFrame functions only).

Patterns find the protected entities. Corpus counts then tell how strongly a term reveals one:
with P(e) the share of texts that hold entity e, and P(e | t) that share among texts with term t,
the term discloses log(P(e | t) / P(e)) of the entity's information -log P(e). Terms of any text
with an entity that disclose more than a threshold are generalised, and those above a higher one
removed, wherever they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, nested, read_table, unnested

KINDS = ["email", "ip", "card", "phone", "term"]

# The leftmost match of a run of characters starts at the run's begin or where the last match
# ended, so tries elsewhere in the run are ruled out; possessive repeats are the same matches
# here and keep the engine from recursion and from quadratic retries.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"\p{L}{2,}+"

SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _spans(text: str, possible: str, pattern: str, kind: int, valid: str) -> str:
    """SQL of the spans of one kind in `text`; `valid` tests a match m.

    The text is split at the matches, and offsets are running lengths of parts and matches, so
    each is found once. Only valid matches are put in the list.
    """
    quoted = pattern.replace("\\", "\\\\")
    return f"""CASE WHEN {possible} THEN aggregate(
        zip_with(transform(split({text}, '{quoted}', -1), g -> char_length(g)), regexp_extract_all({text}, '{quoted}', 0), (g, w) -> named_struct('gap', g, 'value', w)),
        named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)),
        (acc, m) -> named_struct(
            'at', acc.at + coalesce(m.gap, 0) + coalesce(char_length(m.value), 0),
            'out', CASE WHEN m.value IS NOT NULL AND {valid} THEN concat(acc.out, array(named_struct('start', acc.at + m.gap, 'kind', {kind},
                'stop', acc.at + m.gap + char_length(m.value), 'value', m.value))) ELSE acc.out END),
        acc -> acc.out) ELSE cast(array() as array<{SPAN}>) END"""


_DIGITS = "regexp_replace(m.value, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) ->
    CASE WHEN i % 2 = 0 THEN cast(c as int) ELSE cast(c as int) * 2 % 10 + cast(c as int) div 5 END), 0, (a, x) -> a + cast(x as int)) % 10 = 0"""


def base_spans(text: str = "text") -> Column:
    """The pattern spans of a text column as array of (start, kind, stop, value), in order."""
    t = f"coalesce({text}, '')"
    kinds = [
        (f"contains({t}, '@')", EMAIL, "true"),
        (f"{t} rlike '[0-9][.][0-9]+[.][0-9]+[.][0-9]'", IP, "forall(split(m.value, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast('0' || substr(ltrim('0', x), 1, 3) as int) <= 255)"),
        (f"{t} rlike '[0-9](?:[ -]?[0-9]){{13}}'", CARD, f"CASE WHEN length(m.value) < 14 OR length({_DIGITS}) NOT BETWEEN 14 AND 19 THEN false ELSE {_LUHN} END"),
        (f"contains({t}, '+')", PHONE, f"length({_DIGITS}) between 10 and 15"),
    ]
    parts = [_spans(t, possible, pattern, k, valid) for k, (possible, pattern, valid) in enumerate(kinds)]
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def spans_text(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.stop)), ',')")


def _words(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def candidate_terms(base: DataFrame, min_texts: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """((term, value, n_te), (value, n_e)): terms that may disclose an entity, and the entities' texts.

    A term is with an entity if it is anywhere in its text outside the entities themselves.
    Copies of a text count once.
    """
    held = base.select("th", F.explode("base.value").alias("value")).distinct()
    # An entity in fewer texts can have no term in `min_texts` of them.
    entities = maybe_broadcast(materialize(held.groupBy("value").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= min_texts), "pii-entities"))
    held = materialize(held.join(entities.select("value"), "value", "left_semi"), "pii-held")
    texts = base.join(held.select("th").distinct(), "th", "left_semi")
    words = texts.select("th", F.expr(_outside("t")).alias("t")).select("th", F.explode(_words("t")).alias("term"))
    words = materialize(words, "pii-words")
    pairs = words.join(held, "th").groupBy("term", "value").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= min_texts)
    # A term is in at least the texts in which it is with some entity, so its share is at most this.
    seen = words.groupBy("term").agg(F.count("*").alias("n_seen"))
    return materialize(pairs.join(seen, "term").where(F.col("n_te") >= F.col("n_seen") * min_share).drop("n_seen"), "pii-pairs"), entities


def disclosing_terms(base: DataFrame, docs: DataFrame, min_texts: int, min_share: float, generalise: float, remove: float) -> tuple[DataFrame, DataFrame]:
    """((term, share, disclosed, action), (th, term)): terms that reveal an entity, and the texts with candidates.

    `base` has (th, t, base) of the texts with entities, each once, `docs` (th, text). A term
    is in at least `min_texts` different texts with the entity. Counts cover all documents.
    """
    pairs, entities = candidate_terms(base, min_texts, min_share)
    wanted = maybe_broadcast(materialize(pairs.select("term").distinct(), "pii-wanted"))
    found = docs.select("th", F.explode(_words("text")).alias("term")).join(wanted, "term", "left_semi").distinct()
    found = materialize(found.select("th", "term"), "pii-found")
    terms = found.groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.where("text is not null").select(F.count_distinct("th").alias("n"))
    scored = pairs.join(terms, "term").join(entities, "value").crossJoin(F.broadcast(total))  # one row
    share = F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0))
    info = -F.log(F.col("n_e") / F.col("n"))
    scored = scored.select("term", share.alias("share"), F.when(info > 0, (F.log(share) + info) / info).otherwise(0.0).alias("disclosed"))
    scored = scored.where((F.col("share") >= min_share) & (F.col("disclosed") >= generalise))
    best = scored.groupBy("term").agg(F.max("share").alias("share"), F.max("disclosed").alias("disclosed"))
    return best.withColumn("action", F.when(F.col("disclosed") >= remove, "remove").otherwise("generalise")), found


def find_personal_data(
    docs: DataFrame, text_col: str = "text", min_texts: int = 2, min_share: float = 0.8, generalise: float = 0.9, remove: float = 0.98
) -> DataFrame:
    """`docs` with spans (array of start, kind, stop, value) and base (those of the patterns) added.

    Offsets are code points, ends exclusive. Terms are runs of two or more letters, anywhere in
    a text with an entity. A null text has no spans. Rows that repeat an id stay apart;
    rows with equal texts get equal spans. Clashing columns named spans or base are replaced,
    all others stay whatever their names.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text"))
    possible = "contains(t, '@') or contains(t, '+') or t rlike '[0-9][.][0-9]+[.]|[0-9](?:[ -]?[0-9]){13}'"
    base = texts.select("th", F.col("text").alias("t")).where(possible).withColumn("base", base_spans("t")).where("size(base) > 0")
    base = materialize(base.dropDuplicates(["th"]), "pii-base")
    terms, found = disclosing_terms(base, texts, min_texts, min_share, generalise, remove)
    hits = found.join(maybe_broadcast(materialize(terms.select("term", "action"), "pii-terms")), "term").groupBy("th").agg(F.collect_set(F.struct("term", "action")).alias("terms"))
    hits = maybe_broadcast(materialize(hits.select(F.col("th").alias("hit_th"), "terms"), "pii-hits"))
    spans = maybe_broadcast(materialize(base.select(F.col("th").alias("base_th"), "base"), "pii-spans"))
    rows = nested(docs, th=F.xxhash64(text), text=text)
    out = rows.join(spans, F.col("th") == F.col("base_th"), "left").join(hits, F.col("th") == F.col("hit_th"), "left")
    out = out.withColumn("base", F.expr(f"coalesce(base, cast(array() as array<{SPAN}>))"))
    return unnested(out, docs, {"base": F.col("base"), "spans": F.expr(_with_terms("text"))})


def _outside(text: str) -> str:
    """SQL of a text with a space for each of its base spans."""
    return f"""aggregate(base, named_struct('at', 0, 'out', ''), (acc, s) -> IF(s.start < acc.at, named_struct('at', greatest(acc.at, s.stop), 'out', acc.out),
        named_struct('at', s.stop, 'out', concat(acc.out, substr({text}, acc.at + 1, s.start - acc.at), ' '))), acc -> concat(acc.out, substr({text}, acc.at + 1)))"""


def _with_terms(text: str) -> str:
    """SQL of base spans plus those of the terms in `terms` that overlap none of them."""
    words, gaps = f"regexp_extract_all({text}, '\\\\p{{L}}{{2,}}+', 0)", f"split({text}, '\\\\p{{L}}{{2,}}+', -1)"
    return f"""CASE WHEN terms IS NULL THEN base ELSE array_sort(concat(base, filter(aggregate(zip_with(transform({gaps}, g -> char_length(g)), {words}, (g, w) -> named_struct('gap', g, 'w', w)),
        named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)),
        (acc, x) -> named_struct(
            'at', acc.at + coalesce(x.gap, 0) + coalesce(char_length(x.w), 0),
            'out', CASE WHEN exists(terms, t -> t.term = x.w) THEN concat(acc.out, array(named_struct(
                'start', acc.at + x.gap, 'kind', 4, 'stop', acc.at + x.gap + char_length(x.w),
                'value', element_at(filter(terms, t -> t.term = x.w), 1).action))) ELSE acc.out END),
        acc -> acc.out), s -> not exists(base, b -> b.start < s.stop and s.start < b.stop)))) END"""


def sanitise(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """`docs` with every span replaced: pattern spans by [KIND], terms by their first letter and * or by nothing.

    Columns are those of `docs`, whatever their names; a null text stays null.
    """
    found = find_personal_data(nested(docs, text=F.col(text_col).cast("string")), "text", **how)
    clean = F.expr("""aggregate(spans, named_struct('at', 0, 'out', ''), (acc, s) -> IF(s.start < acc.at, acc, named_struct('at', s.stop,
        'out', concat(acc.out, substr(text, acc.at + 1, s.start - acc.at), CASE WHEN s.kind < 4 THEN element_at(array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]'), s.kind + 1)
            WHEN s.value = 'remove' THEN '' ELSE concat(substr(text, s.start + 1, 1), '*') END))),
        acc -> concat(acc.out, substr(text, acc.at + 1)))""")
    return unnested(found, docs, {text_col: F.when(F.col("text").isNotNull(), clean)})


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    more = [F.size("base").cast("bigint").alias("n_base"), F.expr("cast(size(filter(spans, s -> s.kind = 4)) as bigint)").alias("n_terms")]
    return found.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"), *more)
