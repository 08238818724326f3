import random

import pytest

from loamgraph.llm import packing as P
from loamgraph.llm import prose
from loamgraph.llm import quality as Q
from loamgraph.llm import tokens as T
from loamgraph.llm.prose import sentence_chars, statistics

DOC = "doc_id long, text string, lang string, ids string, size int, n_tokens string"


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, None, "clash", 1, "clash") for k, t in enumerate(texts)], DOC)


NASTY = ["", None, " ", "a", "don't stop", "<|endoftext|> x", "é\u0301 \u00a0 x", "a" * 5000, " \n\n  x\t\ty ", "日本語 text 123abc456", "'s's'll", "\U0001f642" * 300, "1234567890" * 400, "word " * 2000 + "\n" * 50]


def test_ids_are_those_of_the_tokenizer_and_decode(spark):
    enc = T.encoder().encode_ordinary
    got = {r["doc_id"]: list(r["ids"]) for r in T.encode_corpus(docs(spark, *NASTY)).collect()}
    assert got == {k: (enc(t) if t else []) for k, t in enumerate(NASTY)}
    assert all(T.decode(got[k]) == (t or "") for k, t in enumerate(NASTY))


def test_pieces_give_the_same_ids_at_any_size(spark):
    rnd = random.Random(3)
    words = ["alpha", "don't", "we'll", "42", "7x", "\n\n", "   ", "…", "naïve", "日本", "'", "''s", "\t", "<|endoftext|>", "\U0001f642"]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " ", "  "]) for _ in range(400)) for _ in range(6)] + NASTY
    enc = T.encoder().encode_ordinary
    for t in texts:
        for chunk, overlap in ((7, 5), (64, 16), (1000, 100)):
            parts = T.pieces(t or "", chunk, overlap)
            assert "".join(parts) == (t or "")
            assert [i for p in parts for i in enc(p)] == enc(t or "")
    for spread in (50, 3000, 1 << 20):  # pieces on other tasks, some of them, none
        got = {r["doc_id"]: list(r["ids"]) for r in T.encode_corpus(docs(spark, *texts), chunk=50, overlap=20, spread=spread).collect()}
        assert got == {k: (enc(t) if t else []) for k, t in enumerate(texts)}
        sizes = {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(docs(spark, *texts), chunk=50, overlap=20, spread=spread).collect()}
        assert sizes == {k: len(v) for k, v in got.items()}


def test_encoding_and_counting_edges(spark, rows):
    assert T.encode_corpus(docs(spark).limit(0) if False else docs(spark, "x").limit(0)).collect() == []
    df = docs(spark, "a b", None)
    assert rows(T.count_tokens(df.union(df))) == [(0, 2), (1, 0)]
    assert T.encode_corpus(df.union(df)).count() == 4


# --- packing ---------------------------------------------------------------------------------------------------------


def check_plan(histogram, capacity):
    used = {}
    n = 0
    for p, times in P.plan(histogram, capacity):
        assert times > 0 and sum(s * k for s, k in p.items()) <= capacity
        n += times
        for s, k in p.items():
            used[s] = used.get(s, 0) + k * times
    assert used == {s: k for s, k in histogram.items() if k}
    return n


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_item_once_and_wastes_little(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([64, 512, 2048])
    histogram = {}
    for _ in range(5000):
        s = min(capacity, max(1, int(rnd.expovariate(8 / capacity))))
        histogram[s] = histogram.get(s, 0) + 1
    total = sum(s * k for s, k in histogram.items())
    assert check_plan(histogram, capacity) <= total / capacity * 1.02 + 1


def test_plan_edges():
    assert P.plan({}, 10) == []
    assert check_plan({10: 7}, 10) == 7 and check_plan({6: 5}, 10) == 5 and check_plan({1: 1}, 10) == 1 and check_plan({5: 4, 3: 2, 2: 2}, 10) == 3


def test_containers(spark, rows):
    df = spark.createDataFrame([(k, n, "clash") for k, n in enumerate([0, None, 5, 10, 23, 5, 7, 3, 1, 1, 1])], "doc_id long, n_tokens long, container string")
    got = P.fill_containers(df, 10).collect()
    fill, parts = {}, {}
    for r in got:
        if r["container"] is not None:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        parts.setdefault(r["doc_id"], []).append((r["part"], r["tokens"]))
    assert max(fill.values()) <= 10 and len(fill) == 6
    assert sorted(parts[4]) == [(0, 10), (1, 10), (2, 3)] and all(len(v) == 1 for k, v in parts.items() if k != 4)
    assert {r["doc_id"] for r in got if r["container"] is None} == {0, 1}


def test_hot_size_and_empty_tables(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 7L, id % 50) as n_tokens")
    budgets = spark.createDataFrame([(1, "a", 100), (2, "b", 64), (2, "b", 64), (3, "c", None)], "budget_id long, label string, capacity_tokens long")
    got = P.fill_all(df, budgets)
    assert got.groupBy("budget_id").count().count() == 2
    used = got.where("container is not null").groupBy("budget_id", "container").sum("tokens").collect()
    assert all(r[2] <= {1: 100, 2: 64}[r[0]] for r in used)
    assert got.where("budget_id = 1").select("doc_id").distinct().count() == 3000
    assert P.fill_all(df.limit(0), budgets).count() == 0 and P.fill_all(df, budgets.limit(0)).count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------

PROSE = [
    "Nobody on the team expected the release to compare twice, but the trace shows exactly that. We ask the parser whether it has moved.",
    "nobody on the team expected the release to compare twice but the trace shows exactly that and we ask the parser whether it has moved",
    "> Nach dem Umbau sank die Zahl der Fälle von 126 auf 2. Wenn der Knoten frisch ist, wird der\n> Zwischenspeicher beim nächsten Mal übersprungen.",
    "Le registre reste en place tant que le lien n'est pas entièrement écrit. Nous avons choisi de ne pas\nreconstruire le segment à chaque démarrage.",
    "Earlier versions would select the whole socket;\nnow only the broken part is touched. It took us two weeks;\nthe reader had been local since the migration of the store.",
    "El número de casos bajó de 44 a 10 después de la mudanza. El enlace se conserva hasta que el testigo queda escrito por completo.",
]
OTHER = [
    "closure by envelope\nscorer of the pointer\ncache with its posting\nreader that was graph",
    "router, packet in the schema, trailing stamp, feature of the package, buffer to be edge, Setting, manifest by symbol",
    "| a | b |\n|---|---|\n| the | of |\n| and | to |", "[2025-04-14T02:00:42] E writer-16: batch and writer\n[2025-04-14T02:00:53] I broker-42: column with its shard",
    "def f(a):\n    return a\n\nclass B:\n    x = 1\n", "Inspect fetch filter flush archive sample registry parse discard scan fold router scanner merge invoice!",
    "zutkxpxfs qnc rkbwruktfw qracasuign dehtzkzjqq xfozz mdbahkbca", "Next »\nOpen in a new tab »\nAll of the docs\nLoading...", '{\n  "a": 1,\n  "b": ["the", "of"]\n}', "1PHuJgF/WX9MmdICGIUVWMXi9Iu3XVQiu8nBEvs30kD",
    "outline         tally           header          receipt\nranker          yes             stream          61.03\nindex           yes             63.70           bucket\n",
    '"""Part of the tools.\n\nWe chose to scan the closure before the setting because a ready edge made the old order unsafe.\n"""\nimport functools\n\ndef f():\n    return 1\n',
    "00000000  1a fc 60 8c 9b 43 f8 4e 22 5f 07 d2 48 cc dd cb\n00000010  b8 73 c8 52 de 58 6d 3e 6f ef 74 46 8e d7 16 10\n00000020  22 d6 9d 55 e7 b1 7d 7d 90 c0 d5 60 63 12 9d 83",
    "a.b = c\nd.e = 4\nf.g = 9", "[[[[ +[[[[$$$$ ~~~~bag::link%%%= <<quota$ }}{{{ ###",
]


def test_running_sentences():
    share = lambda t: (lambda s: s[0] / s[1])(sentence_chars(t))
    assert all(share(t) >= 0.5 for t in PROSE)
    assert all(share(t) < 0.5 for t in OTHER)


def test_statistics():
    assert statistics(None) is statistics("") is statistics(" \u00a0\n\ufeff\u200b") is None
    lang, values = statistics(PROSE[2])
    named = dict(zip(Q.STATISTICS, values, strict=True))
    assert lang == "de" and named["sentence_share"] == 1.0 and named["n_words"] == 22
    assert statistics("12 34")[0] == "other" and statistics("x" * 200_000)[1][1] == 1


ODD = ["ΟΔΟΣ ΟΔΟΣ. İstanbul ΣΑΣ'Σ don't 'tis rock’n’roll's 3f f3 x²½ ٣a naïve\u0301 日本語 Ⅷ _a_b a_1 12.5,7", "the - of -- and — to-the ( of ) \x1cin\x1d is\x1ethat\x1f it\x85was\xa0for\u2028on\u3000are\tas", "a" * 300 + "'s the " + "the,of-" * 90 + " 1" * 5 + " »the«"]


def test_counts_by_token_are_those_of_the_whole_text(monkeypatch):
    def by_text(text):
        words, tokens = prose._WORD.findall(text.lower()), text.split()
        n, solid, letters, digits = len(words), sum(map(len, tokens)), sum(map(len, words)), sum(map(len, prose._DIGITS.findall(text)))
        bare = text.replace("'", "").replace("’", "").split()
        most = max(prose.COMMON_WORDS, key=lambda g: sum(w in prose.COMMON_WORDS[g] for w in words))
        return (
            most if n and sum(w in prose.COMMON_WORDS[most] for w in words) >= 0.05 * n else "other", float(n), letters / n if n else 0.0, max(0, solid - letters - digits) / solid, digits / solid,
            sum(w in prose._ALL_COMMON for w in words) / n if n else 0.0, sum(t.strip(prose._OUTER).isalpha() for t in bare) / len(tokens),
        )

    texts = PROSE + OTHER + ODD + [" ".join(ODD), "\n".join(PROSE + OTHER)]
    first = list(map(statistics, texts))
    for text, (lang, values) in zip(texts, first, strict=True):
        v = dict(zip(Q.STATISTICS, values, strict=True))
        assert (lang, *(v[s] for s in ("n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "common_words", "word_tokens"))) == by_text(text)
    monkeypatch.setattr(prose, "KEPT_TOKENS", 3)  # what was forgotten is counted again
    prose._TOKENS.clear()
    assert list(map(statistics, texts)) == first and len(prose._TOKENS) <= 3


def test_clauses_with_dashes_gaps_and_other_white_space():
    words = "we ask of the scorer and the trace has it".split()
    got = [sentence_chars(s.join(words) + ".")[0] for s in (" ", ", ", " - ", " -- ", "\t", "\xa0", "   ", "\u3000", "-", "/")]
    assert got == [33, 0, 0, 0, 0, 42, 33, 42, 0, 0]
    assert sentence_chars("- we ask the parser - it has moved - and we ask the other one of them -") == (52, 52)


def test_words_that_repeat_are_scanned_once(monkeypatch):
    class Counting:
        def __init__(self, pattern):
            self.pattern, self.chars = pattern, 0

        def findall(self, text):
            self.chars += len(text)
            return self.pattern.findall(text)

    words = Counting(prose._WORD)
    monkeypatch.setattr(prose, "_WORD", words)
    text = "\n\n".join(PROSE * 200)
    assert statistics(text)[1][7] == 1.0
    assert words.chars < len(text) / 10


def test_not_prose(spark, rows):
    texts = PROSE * 6 + OTHER + ["", None, " \u00a0 "]
    df = docs(spark, *texts)
    assert rows(Q.not_prose(df.union(df))) == [(k,) for k in range(len(PROSE) * 6, len(PROSE) * 6 + len(OTHER))]
    assert Q.scored_documents(df).count() == len(texts) - 3
    assert Q.not_prose(df.limit(0)).count() == 0
    assert Q.not_prose(docs(spark, None, "")).count() == 0


def test_tails_decide_without_the_share_of_sentences(spark):
    df = docs(spark, *PROSE * 6, *OTHER)
    judged = Q.judged_prose(Q.scores(Q.document_statistics(df).withColumn("sentence_share", Q.F.lit(1.0)))).collect()
    far = {r.doc_id for r in judged if r.decided_by == "tails"}
    assert len(far) >= 5 and all(k >= len(PROSE) * 6 for k in far) and all(r.tails >= Q.DECIDING and not r.is_prose for r in judged if r.doc_id in far)


def test_sketches_merge(spark):
    stats = Q.document_statistics(docs(spark, *PROSE * 4, *OTHER))
    sketches = Q.quantile_sketches(stats)
    assert rows_of(Q.scores(stats)) == rows_of(Q.scores(stats, sketches))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
