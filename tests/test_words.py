"""Sentence ends, sub-words and other word rules against plain versions."""

import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from textreg.operators import dense as D
from textreg.operators import sentences as E
from textreg.operators import subwords as W
from textreg.queries.text_features import SUBWORDS


@pytest.fixture(scope="module")
def learned(spark):
    """Invented prose with titles, initials, a lower-case abbreviation and numbers."""
    r = random.Random(5)
    words = ["".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.choice([2, 3, 4]))) for _ in range(150)]
    names = [w.capitalize() for w in words[:25]]
    rows = []
    for k in range(700):
        out = []
        for _ in range(r.randrange(2, 7)):
            s = [r.choice(words[25:]) for _ in range(r.randrange(3, 9))]
            if r.random() < 0.35:
                s.insert(r.randrange(1, len(s)), f"Dr. {r.choice(names)}")
            if r.random() < 0.3:
                s.insert(r.randrange(1, len(s)), f"ca. {r.choice(words[25:])}")
            if r.random() < 0.2:
                s.insert(r.randrange(1, len(s)), f"{r.choice('ABCDEFG')}. {r.choice(names)}")
            out.append(" ".join(s).capitalize().replace("dr. ", "Dr. ") if r.random() < 0 else s[0].capitalize() + " " + " ".join(s[1:]) + ".")
        rows.append((k, " ".join(out)))
    docs = spark.createDataFrame(rows, "row_index bigint, text string")
    tokens = E.sentence_tokens(docs).persist()
    return words, names, E.fit_sentences(tokens)


def cut(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "row_index bigint, text string")
    found = {r["row_index"]: r["sentences"] for r in E.split_sentences(E.sentence_tokens(docs), model).collect()}
    return [found.get(k) for k in range(len(texts))]


def test_abbreviations_are_learned(spark, learned):
    words, names, model = learned
    short = {r["word"] for r in model.words.filter(f"score >= {E.ABBREVIATION}").collect()}
    assert {"dr", "ca"} <= short and not short & set(words)
    a, b, c = (w.capitalize() for w in words[30:33])
    got = cut(spark, model, [
        f"Dr. {names[0]} {words[30]}. {a} {words[31]}.", f"{a} ca. {words[40]} {words[41]}! {b}? {c}", f"{a} B. {names[3]} {words[44]}. {b}.",
        f"{a} 3.5 {words[50]}.  {b}\n{words[51]}", "", None, "no end", " . ",
    ])
    assert got == [
        [f"Dr. {names[0]} {words[30]}.", f"{a} {words[31]}."], [f"{a} ca. {words[40]} {words[41]}!", f"{b}?", c],
        [f"{a} B. {names[3]} {words[44]}.", f"{b}."], [f"{a} 3.5 {words[50]}.", f"{b}\n{words[51]}"], None, None, ["no end"], ["."],
    ]


def test_no_text_has_no_sentences(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "row_index bigint, text string")
    tokens = E.sentence_tokens(docs)
    model = E.fit_sentences(tokens)
    assert model.words.isEmpty() and model.pairs.isEmpty() and E.split_sentences(tokens, model).isEmpty()


def test_the_telling_columns_are_enough(spark):
    texts = [
        'He met Dr. Brown.  "Why?" she asked Dr. White. No. 5 of 3.5, e.g. B. Smith... and (so) on.\x0b\nÉté Über straße...  ', "One. Two!  Three?) 1,000. A. b. Ende.", "x", None, "...",
    ] * 3
    tokens = E.sentence_tokens(spark.createDataFrame(list(enumerate(texts)), "row_index bigint, text string")).persist()
    told = E.telling(tokens)
    assert set(told.columns) == {"word", "dotted", "ends", "first", "next_word", "next_first"} and told.filter("next_word IS NULL AND ends != ''").count() <= 12
    whole, small = E.fit_sentences(tokens), E.fit_sentences(told)
    assert sorted(whole.words.collect()) == sorted(small.words.collect()) and sorted(whole.pairs.collect()) == sorted(small.pairs.collect())
    facts = {r["word"]: r for r in whole.words.collect()}
    assert facts["dr"]["n"] == facts["dr"]["dotted"] == 6 and facts["straße"]["lower"] == 3 and facts["#"]["n"] == 9
    assert [r["piece"] for r in tokens.filter("row_index = 1").orderBy("pos").collect()] == ["One. ", "Two!  ", "Three?) ", "1,000. ", "A. ", "b. ", "Ende."]
    assert [r["ends"] for r in tokens.filter("row_index = 1").orderBy("pos").collect()] == [".", "!", "?", ".", ".", ".", "."]


def test_hashed_vectors_shuffle_no_tokens(spark):
    import hashlib

    texts = [["a", "b", "a", "né"], [], None, ["x"] * 50 + [str(i) for i in range(300)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_index bigint, tokens array<string>")
    for size in (1, 7, 32, 1000):
        coded = D.hashed_vectors(docs, size)
        got = {r["row_index"]: np.array(r["embedding"]) for r in coded.collect()}
        assert len(got) == len(texts)
        for k, words in enumerate(texts):
            want = np.zeros(size)
            for w in words or []:
                n = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
                want[n % size] += 1 if n >> 63 else -1
            length = np.linalg.norm(want) or 1.0
            assert np.allclose(got[k], want / length, atol=1e-6), (size, k)
    plan = coded._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION" not in coded._jdf.queryExecution().executedPlan().toString() and "RepartitionByExpression" not in plan


def test_association_against_the_plain_ratio(spark):
    def plain(a, b, both, n):
        def fit(k, m, q):
            return sum(x * np.log(p) for x, p in ((k, q), (m - k, 1 - q)) if x)

        p, p1, p2 = b / n, both / a, (b - both) / (n - a)
        return -2 * (fit(both, a, p) + fit(b - both, n - a, p) - fit(both, a, p1) - fit(b - both, n - a, p2))

    cases = [(100, 50, 20, 1000), (10, 400, 3, 5000), (30, 40, 25, 90)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "a double, b double, k double, n double")
    got = [r[0] for r in df.select(E.association(*(F.col(c) for c in "abkn"))).collect()]
    assert np.allclose(got, [plain(*c) for c in cases])


# ---- sub-words ----


def plain_merges(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merges_against_scanning_all_pairs():
    ranks = W.read_ranks(SUBWORDS)
    r = random.Random(2)
    words = ["".join(r.choice(" abcdehilnorstéß中☃0'") for _ in range(r.randrange(0, 25))) for _ in range(400)] + ["aaaaaaaaaaaaaaaaa", "tokenization"]
    for w in words:
        assert W.merge_bytes(w.encode(), ranks) == plain_merges(w.encode(), ranks)


@pytest.mark.parametrize(("length", "pad"), [(512, None), (12, 0), (3, None)])
def test_budget_marks_and_mask(spark, length, pad):
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=W.read_ranks(SUBWORDS), special_tokens={})
    texts = ["Hello  world, it's 2024!\n\nYes", "", None, "unbelievably " * 40, "中文 été ☃☃", "a", "a"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "row_index bigint, text string, pos int")
    got = {r["row_index"]: r for r in W.encode_subwords(docs, SUBWORDS, max_length=length, begin=1, end=2, pad=pad).collect()}
    for k, text in enumerate(texts):
        ids = known.encode_ordinary(text or "")
        want = [1, *ids[: length - 2], 2]
        filler = [pad] * (length - len(want)) if pad is not None else []
        assert got[k]["ids"] == want + filler and got[k]["mask"] == [1] * len(want) + [0] * len(filler)
        assert got[k]["truncated"] == (len(ids) > length - 2)
    with pytest.raises(ValueError, match="max_length"):
        W.encode_subwords(docs, SUBWORDS, max_length=2, begin=1, end=2)


def test_pooling_takes_the_mask(spark):
    """Padding has a vector but no weight."""
    docs = spark.createDataFrame([(0, "a b"), (1, "")], "row_index bigint, text string")
    encoded = W.encode_subwords(docs, SUBWORDS, max_length=6, begin=1, pad=0)
    ids = sorted({i for r in encoded.collect() for i in r["ids"]})
    vectors = spark.createDataFrame([(i, [float(k), 1.0 + k]) for k, i in enumerate(ids)], "id int, vec array<double>")
    pooled = {r["row_index"]: r["embedding"] for r in D.masked_mean_pool(W.masked_rows(encoded, vectors), "row_index", "vec", "mask").collect()}
    for r in encoded.collect():
        mine = [np.array([ids.index(i), 1.0 + ids.index(i)]) for i, m in zip(r["ids"], r["mask"], strict=True) if m]
        assert np.allclose(pooled[r["row_index"]], np.mean(mine, axis=0))


# ---- word rules and other scripts ----


def ruled(text):
    """The rules one by one, each a pass that sets its matches apart."""
    import regex

    out = f" {text.lower()} "
    out = regex.sub(r"(\.{3,})", r" \1 ", out)
    out = regex.sub(r"(--)", r" \1 ", out)
    out = regex.sub(r"""([;@#$%&?!\[\](){}<>"])""", r" \1 ", out)
    out = regex.sub(r"([,:])(?![0-9])", r" \1 ", out)
    out = regex.sub(r"""(?<!\.)(\.)(?=["'\])}>»”’\s]*$)""", r" \1 ", out)
    for a, b in (("can", "not"), ("gon", "na"), ("wan", "na"), ("got", "ta"), ("gim", "me"), ("lem", "me")):
        out = regex.sub(rf"(?<![\p{{L}}\p{{N}}])({a})({b})(?![\p{{L}}\p{{N}}])", r"\1 \2", out)
    out = regex.sub(r"(n't|'(?:s|m|d|ll|re|ve))(?![\p{L}\p{N}])", r" \1 ", out)
    return out.split()


def test_word_rules_against_passes_of_each(spark):
    from textreg.functions.tokens import tokenize_by_rules

    r = random.Random(8)
    parts = ["don't", "can't", "he's", "'s", "cannot", "cannots", "gonna", "gotta.", "lemme", "U.S.", "3.14", "1,000", "a,b", "12:30", "...", "..", ".", "--", "\"", "(", ")",
             "'", "word", "é", " ", " ", " ", "\n", "we'll", "n't", "?!", ";", "»", "5%"]
    texts = ["I don't.", "", None, "He said \"no...\" (twice)."] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x["w"] for x in df.select("i", tokenize_by_rules("t").alias("w")).collect()}
    assert got[0] == ["i", "do", "n't", "."] and got[2] is None
    assert got[3] == ["he", "said", "\"", "no", "...", "\"", "(", "twice", ")", "."]
    for i, t in enumerate(texts):
        if t is not None:
            assert got[i] == ruled(t), t


def test_other_scripts_in_latin_letters(spark):
    from textreg.functions.text import normalize_feature_name, spellings, transliterate

    cases = {
        "Привет, Щука": "Privet, Shchuka", "ΓΕΙΆ σου Ψάρι": "GEIA sou Psari", "カタカナ がぎ": "katakana gagi", "€5 №7 ½": "EUR5 No.7 1/2", "ação ß": "ação ß", "": "",
        "שלום": "shlvm", "Ёж": "Ezh",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {x["t"]: x["u"] for x in df.select("t", transliterate("t").alias("u")).collect()}
    assert got == cases | {None: None}
    every = spark.createDataFrame([(k,) for k in spellings()], "t string").select("t", transliterate("t").alias("u")).collect()
    assert {x["t"]: x["u"] for x in every} == spellings()
    named = spark.createDataFrame([("Бассейн (крытый) №2",)], "t string").select(normalize_feature_name("t")).first()[0]
    assert named == "bassein_No.2"


def test_runs_of_other_scripts(spark):
    from textreg.functions.text import _ranges, spellings, transliterate

    # Every kind of letter beside every other, and long runs of both; the ranges hold what is spelled and no accented letter.
    table = spellings()
    some = [*list(table)[::7], "a", "é", "\n", "ß", "𝒳", "中"]
    texts = ["".join(a + b for b in some) for a in some] + ["é" * 20_000 + "Щ" * 20_000 + "a" * 20_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", transliterate("t").alias("u")).collect()
    assert all(r["u"] == "".join(table.get(ch, ch) for ch in r["t"]) for r in got) and len(got) == len(texts)
    assert _ranges("acz", 4) == r"\x{61}-\x{63}\x{7a}-\x{7a}"


def test_plain_latin_step_by_step(spark):
    from textreg.functions.text import LATIN_SPELLINGS, PLAIN_MARKS, to_plain_latin

    cases = {"plain, as it is": "plain, as it is", "ação": "acao", "m² ½": "m2 1/2", "straße “Жук”…": 'strasse "zhuk"...', "": "", "e\u0301": "e"}
    cases |= {o: mark for mark, others in PLAIN_MARKS.items() for o in others} | LATIN_SPELLINGS
    cases = {k: v for k, v in cases.items()} | {f"a{k}é": f"a{v}e" for k, v in cases.items()}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", to_plain_latin(F.lower("t")).alias("u"))
    assert {r["t"]: r["u"] for r in rows.collect()} == cases | {None: None}
    # Names in ASCII pass every step by: the steps stand behind a test of the letters.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN RLIKE(") >= 2


def test_base_forms(spark):
    from textreg.operators.lemmas import base_forms

    lexicon = "cat bus box church wolf city glass man as a clas class child".split()
    words = "cats buses boxes churches wolves cities glasses women men dogs as classes glass s children cat".split() + [None, ""]
    frame = lambda rows: spark.createDataFrame([(w,) for w in rows], "word string")
    exceptions = spark.createDataFrame([("children", "child"), ("men", "mann"), ("men", "man")], "word string, base string")
    got = {r["word"]: r["base"] for r in base_forms(frame(words), frame(lexicon), exceptions).collect()}
    assert got == {
        "cats": "cat", "buses": "bus", "boxes": "box", "churches": "church", "wolves": "wolf", "cities": "city", "glasses": "glass", "men": "man",
        "as": "a", "classes": "class", "children": "child",
    }
    assert base_forms(frame(["men"]), frame(lexicon)).first()["base"] == "man" and base_forms(frame([]), frame(lexicon)).isEmpty()
