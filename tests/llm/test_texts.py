import collections
import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pytest
import regex
import sentencepiece

from factloom.llm import piece_bpe, suffix_dedup
from factloom.llm import suffix_array as sa_module
from factloom.llm.langid import UNKNOWN, held_out, identify_languages, keep_identified, learn
from factloom.llm.lines import drop_repeated_lines, keep_first_lines, repeated_runs, winnowed
from factloom.llm.pii import find_personal_data, sanitise, spans_text
from factloom.llm.piece_bpe import PieceBpe, default_model, piece_tokens
from factloom.llm.suffix_array import permuted_lcp, suffix_array
from factloom.llm.suffix_dedup import remove_repeats
from factloom.llm.wordpiece import load, token_counts, vocabulary

SCHEMA = "doc_id long, text string"


# language ID


def _tongues(n=120):
    r = random.Random(1)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["xyzzy", "plugh", "quux", "zork"]}
    return [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(1, 30))), lang, "x") for i in range(n) for lang in [r.choice(["aa", "bb"])]]


def test_languages_are_told_and_never_from_labels(spark):
    rows = _tongues() + [(1000, None, "aa", "x"), (1001, "", "bb", "x"), (1002, "123 !!", "aa", "x"), (1003, "lorem " * 20000, None, "x"), (1003, "zork", None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string, score string")
    got = identify_languages(docs).collect()
    assert all(r.lang_pred == r.lang for r in got if r.doc_id < 1000) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert sorted(r.lang_pred for r in got if r.doc_id == 1003) == ["aa", "bb"]
    swapped = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 'zz' else lang end as lang", "score")
    key = lambda r: (r.doc_id, r.text or "")
    assert [r.lang_pred for r in sorted(identify_languages(swapped).collect(), key=key)] == [r.lang_pred for r in sorted(got, key=key)]
    kept = keep_identified(docs)
    gone = (1000, 1001, 1002)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([r for r in rows if r[0] not in gone], key=str)


def test_languages_against_exact_sets(spark):
    """Plain sets of n-grams in place of the filters, on real texts; all labelled rows are used by both."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.withColumn("held", held_out()).collect()

    def fold(text):
        out = " "
        for c in text or "":
            c = c.lower() if unicodedata.category(c)[0] in "LM" and len(c.lower()) == 1 else c if unicodedata.category(c)[0] in "LM" else " "
            out += "" if c == out[-1] == " " else c
        out = out if out[-1] == " " else out + " "
        return out if out.strip() else ""

    def ngrams(text):
        x = fold(text)
        return [x[i : i + n] for n in (3, 4) for i in range(len(x) - n + 1)]

    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if not r.held and r.text is not None and r.lang is not None:
            counts[r.lang].update(ngrams(r.text))
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    own = {lang: {g for g, x in c.items() if x >= 0.5 * max(o.get(g, 0) for o in rate.values())} for lang, c in rate.items()}
    got = {r.doc_id: r for r in identify_languages(docs, fit_docs=10**9).collect()}
    differ = right = held = 0
    for r in rows:
        hits = {lang: sum(g in s for g in ngrams(r.text)) for lang, s in own.items()}
        best = max(hits.values())
        want = UNKNOWN if not fold(r.text) else max(counts, key=lambda x: (hits[x], x)) if best else None
        if want not in (None, UNKNOWN) and sorted(hits.values())[-2] == best:
            continue  # a tie
        differ += want is not None and got[r.doc_id].lang_pred != want
        if r.held and r.lang is not None and want != UNKNOWN:
            held, right = held + 1, right + (got[r.doc_id].lang_pred == r.lang)
        if want not in (None, UNKNOWN):
            assert abs(got[r.doc_id].score - best / sum(hits.values())) < 0.02 + 2 / sum(hits.values())
    assert differ <= 0.002 * len(rows) and right >= 0.99 * held > 100


def test_all_n_grams_of_the_fit_count_and_filters_hold_many_languages(spark):
    rows = [(3 * i + k, f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(99 + i % 7)} " * 3, f"l{i:03d}") for i in range(150) for k in range(3)]
    model = learn(spark.createDataFrame(rows, SCHEMA + ", lang string"))
    assert len(model.langs) == 150 and model.words == 3
    assert all(model.predict(t)[0] == lang for _, t, lang in rows)


def test_languages_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], SCHEMA + ", lang string")
    assert identify_languages(empty).count() == 0
    assert identify_languages(spark.createDataFrame([(1, "abc", None)], SCHEMA + ", lang string")).first().lang_pred == "und"


# suffix arrays


@pytest.mark.parametrize("full", [64, 1, 10**9])  # as it is, always whole buckets, always suffix by suffix
def test_suffix_array_and_prefixes(monkeypatch, full):
    monkeypatch.setattr(sa_module, "FULL", full)
    r = random.Random(2)
    for _ in range(150):
        data = np.array([r.randrange(r.choice([1, 2, 3, 250])) for _ in range(r.randint(0, 60))], np.uint8)
        b = data.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert suffix_array(data).tolist() == want
        if len(b):
            plcp = permuted_lcp(data, suffix_array(data), 20)
            for i in range(1, len(want)):
                x, y = b[want[i - 1] :], b[want[i] :]
                n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
                assert plcp[want[i]] == min(n, 20)


def _repeats(rows, length=400):
    docs = [(i, (t or "").encode()) for i, t in rows]
    n = collections.Counter(b[s : s + length] for _, b in docs for s in range(len(b) - length + 1))
    out = []
    for i, b in docs:
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                gone[s + 1 : s + length + 1] = True
        spans = int((np.diff(gone.astype(int)) > 0).sum())
        kept = bytes(c for c, x in zip(b, gone[1:]) if not x)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1 << 20, 600])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)

    def u(k, n=1900):
        return "".join(hashlib.md5(f"{k}-{i}".encode()).hexdigest() for i in range(60))[:n]

    rows = [(1, None), (2, ""), (3, "a" * 1500), (4, "abcdefghij" * 100), (5, u(1)), (5, u(1)), (None, u(2) + "x" + u(2)), (6, u(3, 399)), (7, u(3, 399)), (8, u(4, 400)), (9, "é" + u(4, 400) + "ß"), (10, "a" * 401)]
    rows += [(11, u(5, 900) + u(6)), (12, u(5)[200:1100]), (13, u(7)), *[(20 + i, u(30 + i, 100) + u(8, 600) + u(60 + i, 200)) for i in range(12)]]
    got = sorted((tuple(r) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == _repeats(rows)
    kept = remove_repeats(spark.createDataFrame(rows, SCHEMA), texts=True).where("doc_id = 13").first()
    assert bytes(kept.kept).decode() == u(7)
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_that_share_a_passage_of_over_fifty_words(spark):
    r = random.Random(11)

    def words(n):
        return ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9))) for _ in range(n)]

    passages = [words(n) for n in (51, 51, 60, 200, 31, 20)]
    rows = []
    for i, p in enumerate(passages):
        for k in range(3):
            rows.append((10 * i + k, " ".join(words(r.randint(0, 80))) + r.choice([" ", "\n", "\t  "]) + r.choice([" ", "\n "]).join(p) + " " + " ".join(words(r.randint(0, 80)))))
    twice = " ".join(words(60))
    rows += [(100, f"{twice} x {twice}"), (101, " ".join(words(300))), (102, None), (103, " "), (104, " ".join(words(51))), (105, " ".join(passages[3])), (106, "é" * 3000 + " ß" * 100)]
    got = {x.doc_id: x.n_passages for x in remove_repeats(spark.createDataFrame(rows, SCHEMA), passages=True).collect()}
    assert {i for i, n in got.items() if n} == {10 * i + k for i in range(4) for k in range(3)} | {105} and all(n is not None for n in got.values())


# lines


def _runs(rows, least=8):
    """Every later window with words at both ends and `least` words in all goes."""
    seen, out = set(), {}
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is not None, r[0])):
        ls, gone = t.split("\n"), set()
        n = [len(re.findall("[^\x20\x09-\x0d]+", x)) for x in ls]
        for s in range(len(ls)):
            for e in range(s, len(ls)):
                if n[s] and n[e] and sum(n[s : e + 1]) >= least:
                    key = tuple(ls[s : e + 1])
                    gone |= set(range(s, e + 1)) if key in seen else set()
                    seen.add(key)
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone))
    return out


def _many_lines():
    r = random.Random(7)
    verse = [f"verse line{i} here" for i in range(20)]
    rows = [(i, "\n".join([f"head {i}", *verse, f"tail {i}"])) for i in range(3)]
    pool = [" ".join(r.choice("abcd") for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 9, 10)] + ["", " "]
    rows += [(10 + i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))) for i in range(150)]
    return rows + [(300, "x y z\n" * 20), (301, ""), (302, None), (303, "\n".join(["same words here again and over"] * 300)), (None, "\n".join(verse)), (304, " \n\n")]


def test_lines_against_brute_force(spark):
    rows = _many_lines()
    docs = spark.createDataFrame([(*x, "c", "d") for x in rows], SCHEMA + ", _lines string, th string")
    want = _runs(rows)
    got = drop_repeated_lines(docs, counts=("n", "k"))
    assert {r.doc_id: (r.text, r.n, r.k) for r in got.collect() if r.text is not None} == want and want[1][0] == "head 1\ntail 1"
    assert got.where("doc_id = 302").first()[1:] == (None, "c", "d", 0, 0)
    kept = keep_first_lines(docs)
    assert kept.columns == docs.columns and {(r._lines, r.th) for r in kept.collect()} == {("c", "d")}
    assert {r.doc_id: r.text for r in kept.collect()} == {302: None} | {i: t for i, (t, _, k) in want.items() if not k or t.split()}
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def test_winnowing_selects_few_positions_and_every_match_holds_one(spark):
    rows = [r for r in _many_lines() if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA)
    places = collections.defaultdict(set)
    for r in winnowed(docs).collect():
        assert r.first <= r.at <= r.last
        places[r.fp].add((r.id, r.at))
    lines = sum(len([x for x in t.split("\n") if x.split()]) for _, t in rows if t)
    assert sum(map(len, places.values())) < 0.9 * lines
    found = repeated_runs(docs).collect()
    assert found and all(any(len(p) > 1 and any(i == r.id and r.first <= at <= r.last for i, at in p) for p in places.values()) for r in found)


def test_rows_equal_in_id_and_text_are_one_document(spark):
    text = "one two three four\nfive six seven eight\nnine"
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x\ny"), (2, text)], SCHEMA)
    assert sorted((r.doc_id or 0, r.text) for r in drop_repeated_lines(docs).collect()) == [(0, "x\ny"), (1, text), (1, text), (2, "")]


def test_one_line_that_repeats_between_other_lines_goes(spark):
    long = "this passage of ten words or more is one line"
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, long), (4, "short line\nother"), (5, "short line\nmore"), (6, f"{long} once")]
    got = {r.doc_id: r.text for r in keep_first_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "c\nd" if i == 2 else t for i, t in rows if i != 3}


# personal data

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and _luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_patterns_against_brute_force(spark):
    texts = [None, "", "a@b.c_d@e.f", "x.y@z..w a@b-c.d.e.", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 00.0.0.0", "😀 a@b.co 😀 +1 (555) 123-4567 é 4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "+123456789 +1234567890123456"]
    texts += ["a" * 20000 + "@", "1" * 20000, "1." * 9000, "a@" + "b." * 9000 + "c", " ".join(["a@b.c"] * 300), "a@@b.c +44 20 7946 0958-"]
    r = random.Random(4)
    texts += ["".join(r.choice(["1", "4", ".", "@", "+", " ", "-", "a", "_", "(", ")", "255", "b.c", "é"]) for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], SCHEMA + ", base string")
    got = {r.doc_id: r.b for r in find_personal_data(docs).select("doc_id", spans_text("base").alias("b")).collect()}
    assert got == {i: _base(t) for i, t in enumerate(texts)}


def test_disclosing_terms(spark):
    rows = [(i, f"Zanzibarian office number {i} mail zed@corp.org today row{i}") for i in range(8)] + [(100 + i, f"plain office words number {i} today of mail") for i in range(60)] + [(300, None), (301, "Zanzibarian again")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.s for r in find_personal_data(docs).select("doc_id", spans_text("spans").alias("s")).collect()}
    assert "term:0:11" in got[0] and "email" in got[0] and got[301] == "term:0:11" and got[100] == "" and got[300] == ""
    assert sanitise(docs).where("doc_id = 0").first().text.startswith(" office number 0 mail [EMAIL] today") or sanitise(docs).where("doc_id = 0").first().text.startswith("Z* office")
    assert find_personal_data(docs.limit(0)).count() == 0


def _disclosing(texts, min_texts=2, min_share=0.8, generalise=0.9, remove=0.98):
    """Terms and what is done with them, counted over sets of texts."""
    texts, words, held, outside = sorted({t for t in texts if t is not None}), {}, {}, {}
    for t in texts:
        words[t] = set(regex.findall(r"\p{L}{2,}", t))
        spans = [(m.start(), m.end(), m[0]) for k, p in enumerate(PATTERNS) for m in re.finditer(p, t) if f"{KINDS[k]}:{m.start()}:{m.end()}" in _base(t).split(",")]
        held[t] = {v for _, _, v in spans}
        outside[t] = set(regex.findall(r"\p{L}{2,}", "".join(" " if any(a <= i < b for a, b, _ in spans) else c for i, c in enumerate(t))))
    entity = {v: {t for t in texts if v in held[t]} for v in set().union(*held.values())}
    out = {}
    for v, with_v in entity.items():
        for term in set().union(*(outside[t] for t in with_v)):
            n_te, n_t = sum(term in outside[t] for t in with_v), sum(term in words[t] for t in texts)
            if len(with_v) >= min_texts and n_te >= min_texts and n_te / n_t >= min_share:
                info = -math.log(len(with_v) / len(texts))
                x = (math.log(n_te / n_t) + info) / info if info > 0 else 0
                if x >= generalise:
                    out[term] = max(out.get(term, 0), x)
    return {t: "remove" if x >= remove else "generalise" for t, x in out.items()}


def test_terms_against_counting(spark):
    r = random.Random(9)
    names = ["Abel", "Bo", "Cyrus", "Dora", "Élan", "Frida"]
    mails = [f"{n[:2].lower().replace('é', 'e')}@corp{i}.org" for i, n in enumerate(names)]
    rows = []
    for i in range(150):
        k, words = r.randrange(6), [r.choice("alpha beta gamma delta note memo call x".split()) for _ in range(r.randint(3, 12))]
        if r.random() < 0.6:
            words += [mails[k], names[k]] if r.random() < 0.9 else [mails[k]]
        elif r.random() < 0.08:
            words.append(names[k])
        r.shuffle(words)
        rows.append((i, " ".join(words), "a", "b"))
    rows += [(200, None, "a", "b"), (201, "", "a", "b"), (202, rows[0][1], "a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA + ", terms string, th string")
    want, got = _disclosing([t for _, t, _, _ in rows]), find_personal_data(docs).collect()
    assert len(want) > 2
    for row in got:
        text, taken = row.text or "", [(s.start, s.stop) for s in row.base]
        terms = [(m.start(), m.end(), want[m[0]]) for m in regex.finditer(r"\p{L}{2,}", text) if m[0] in want and not any(a < m.end() and m.start() < b for a, b in taken)]
        assert [(s.start, s.stop, s.value) for s in row.spans if s.kind == 4] == terms and (row.terms, row.th) == ("a", "b")


def test_disclosing_terms_far_off_short_and_in_few_texts(spark):
    far = " ".join(f"filler{'abcdefghij'[i % 10]} of words" for i in range(40))
    rows = [(i, f"Quorvath {far if i < 3 else 'signs'} this mail qu@corp.org") for i in range(10)]
    rows += [(20 + i, f"Kim {far} wrote +1 555 123 4567 there") for i in range(2)] + [(21, f"Kim {far} wrote it +1 555 123 4567 here")]
    rows += [(100 + i, f"{far} signs this mail wrote it here there number {i}") for i in range(60)] + [(300, "Quorvath"), (301, "Kim"), (302, "corp org")]
    got = {r.doc_id: r.s for r in find_personal_data(spark.createDataFrame(rows, SCHEMA), min_share=0.6, generalise=0.7).select("doc_id", spans_text("spans").alias("s")).collect()}
    assert got[300] == "term:0:8" and got[301] == "term:0:3" and got[302] == "" and got[100] == "" and got[0].startswith("term:0:8,email")


# tokens

ODD = ["", " ", "  a", "a  b ", "a▁b ▁▁  x", "\x00a\n\n", "é́ ﬁ ½ 😀😀 \r\n a", "<s> </s> <unk> <0x41>", "a" * 300, "    " * 20 + "x", "\n a \n", "word " * 5000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


def test_pieces_against_the_library(library):
    bpe, r = PieceBpe(default_model()), random.Random(5)
    texts = ODD + ["".join(r.choice(["a", "b", "▁", " ", "th", "e", "\n", "é", "0", "1", "the", "日", "本", "😀", "\t", "in", "g"]) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        ids = library.encode(t, add_eos=True)
        assert bpe.encode(t) == ids and bpe.encode_text(t)[1] == bpe.decode(ids) == library.decode(ids), t


def test_decoded_text_comes_from_the_ids():
    bpe = PieceBpe(default_model())
    ids, text = bpe.encode_text("plain words in a row")
    tokens = ids.split(" ")
    tokens[1] = str(bpe.ids["▁other"]) if "▁other" in bpe.ids else str(bpe.ids["▁the"])
    assert text == "plain words in a row" != bpe.decode_ids(" ".join(tokens)) and bpe.decode_ids(ids) == text


def test_long_spans_are_not_kept_and_memos_are_bounded(monkeypatch):
    bpe = PieceBpe(default_model())
    bpe.encode_text("a" * 5000 + " b")
    assert max(map(len, bpe.words)) <= 200
    monkeypatch.setattr(piece_bpe, "MEMO_CHARS", 100_000)
    for i in range(2000):
        bpe.words[f"w{i}"]
    assert bpe.words.held <= 100_000 and len(bpe.words) < 1000
    trie = load(default_model())
    trie.count_text("x" * 5000)
    assert max(map(len, trie.memo), default=0) <= 100


def test_token_query_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "again")]
    got = [tuple(r) for r in piece_tokens(spark.createDataFrame(rows, SCHEMA), ids=True).collect()]
    for (i, t), r in zip(rows, got):
        ids = library.encode(t or "", add_eos=True)
        assert r[:3] == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r[3] == hashlib.sha256(library.decode(ids).encode()).hexdigest() and list(r[4]) == ids
    assert piece_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_word_pieces_against_greedy_matching(spark):
    initial, inner = map(set, vocabulary(default_model()))

    def greedy(word):
        at = n = 0
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if word[at:e] in (inner if at else initial)), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß日😀<>0") for _ in range(r.randint(1, 14))) for _ in range(3000)] + ["a" * 2000, "the", "unbelievable"]
    trie = load(default_model())
    assert [trie.count(w) for w in words] == [greedy(w) for w in words]
    rows = [(1, " ".join(words)), (2, None), (3, " \n"), (1, "the")]
    got = [tuple(x) for x in token_counts(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(1, len(words), sum(map(greedy, words))), (2, 0, 0), (3, 0, 0), (1, 1, 1)]
