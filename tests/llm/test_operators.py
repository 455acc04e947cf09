"""The corpus operators against plain versions of what they compute, and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumspark.llm import decontaminate, graph, jaccard, language, licenses, mixing, secrets, surrogates, token_files, topk, toxicity
from vellumspark.llm.common import WORD_PATTERN, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and repeated rows, a long text, one without letters, and columns whose names clash with inner ones.
ODD = [
    (1, "one two three four five six seven", "en", "a", 1), (1, "one two three four five six seven", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, "word " * 60_000, "en", "a", 1),
    (5, "12 34 !!", None, "c", 1), (6, "ONE two, three four five six seven.", "de", None, 1), (7, "été ça İ ﬁ\x1c中文 'll <|endoftext|> _x_", "fr", "a", 1), (None, "no id here", "en", "a", 1),
]


def odd(spark):
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.withColumns({c: F.lit(9) for c in ("n_words", "score", "node", "copies", "size", "hit", "items", "key", "rep", "bands", "text_hash", "__x", "taken", "label", "start")})


def empty(spark):
    return odd(spark).filter("false")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_words_agree_with_their_pattern():
    draw = random.Random(1)
    for _ in range(500):
        text = "".join(draw.choice("aZ09 _-'éßΩ中\n\x7f{`@/:") for _ in range(20))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        assert [w.decode() for w in words_of(text)] == re.findall(WORD_PATTERN, low)


# --- 1 -------------------------------------------------------------------------------------------------------


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    docs = odd(spark).filter("doc_id is not null")
    manifest = token_files.write_token_files(docs, shard_bytes=50_000, length=64)
    got = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc, text in sorted(((r[0], r[1] or "") for r in ODD if r[0] is not None), key=lambda x: x[0]):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, token_files.END_ID]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.read_token_files(token_files.write_token_files(empty(spark))).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "c"), (3, "d"), (3, "d")], "doc_id long, text string")
    many = token_files.read_token_files(token_files.write_token_files(nulls, shard_bytes=1)).orderBy("start").collect()
    assert [r["doc_id"] for r in many] == [None, None, 3, 3] and many[2]["ids_crc32"] == many[3]["ids_crc32"]
    shard = manifest.orderBy("shard").first()
    tokens = token_files.TokenFile(shard["path"] + ".arrow")
    ids, mask = tokens.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata and mask[0].as_py() and tokens.sequence(1)[1].buffers()[1].address == mask.buffers()[1].address
    last = tokens.sequence((shard["n_ids"] - 1) // 64)[1]
    assert last.true_count == (shard["n_ids"] - 1) % 64 + 1


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abXYéÉß'`0129²½Ⅷ.,_-!|<>\t\n ΣσςİﬁＡ\x1c\x85中가́"), max_size=16))
def test_encoder_gives_the_ids_of_whole_texts(text):
    encoder = _encoder()
    assert np.frombuffer(next(encoder.encode_all([text])), "<u2").tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]


_held = []


def _encoder():
    if not _held:
        import public_tokenizers

        _held.append(token_files.Encoder(public_tokenizers.path(token_files.TOKENIZER), 2))
    return _held[0]


# --- 2, 3 ----------------------------------------------------------------------------------------------------


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    model = language.fit(odd(spark))
    got = language.identify(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (2, 3, 5))
    assert language.identify(empty(spark), language.fit(empty(spark))).count() == 0


def test_language_kernel():
    texts = [("aab ab", "x"), ("bba ba", "y"), ("abab", "x"), ("baba", "y")]
    model = language.train(texts)
    symbols = language._Symbols(model.letters)
    rows = np.zeros((2, len(model.landmarks)), np.float32)
    sets = []
    for row, text in zip(rows, ("aab ab", "bba"), strict=True):
        language.presence_row(language.symbols_of(text, symbols), model.columns, row)
        sets.append({text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)})
    marks = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t, _ in texts]
    known = set().union(*marks)
    for got, own in zip(model.kernel(rows), sets, strict=True):
        own &= known
        assert np.allclose(got, [len(own & m) / (len(own) * len(m)) ** 0.5 for m in marks])


def test_language_predictions_of_a_plain_version(spark, monkeypatch):
    """The same prediction from sets of n-grams and the dual system of the regression, without the Nyström map."""
    monkeypatch.setattr(language, "BLOCK", 24)
    rng = np.random.default_rng(5)
    draw = lambda letters, n: "".join(rng.choice(list(letters + "  "), n))
    spoken = {"x": "aabcde", "y": "bdefgg", "z": "chiijb"}
    texts = [(draw(letters, int(n)), lang) for n in rng.integers(8, 70, 14) for lang, letters in spoken.items()]
    model = language.train(texts, landmarks=12)
    pieces = [(t[i : i + 24], lang) for t, lang in texts for i in range(0, len(t), 24) if t[i : i + 24].strip()]
    chosen = [[t for t, lang in pieces if lang == x][:4] for x in spoken]
    order = [t for t, _ in pieces if any(t in c for c in chosen)]
    sets = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    marks = [sets(t) for t in order]
    known = set().union(*marks)

    def kernel(t):
        own = sets(t) & known
        return [len(own & m) / max(1, len(own) * len(m)) ** 0.5 for m in marks]

    rows, square = np.array([kernel(t) for t, _ in pieces]), np.array([kernel(t) for t in order])
    signs = np.array([[1.0 if lang == x else -1.0 for x in spoken] for _, lang in pieces])
    duals = np.linalg.solve(rows.T @ rows + language.RIDGE * square, rows.T @ signs)
    asked = [t for t, _ in texts] + [draw("abcdefghij", 200), "", "  ", None]
    langs, scores = language.predict(model, language._Symbols(model.letters), asked)
    for text, lang, score in zip(asked, langs, scores, strict=True):
        if not text or not text.strip():
            assert (lang, score) == ("und", 0)
            continue
        k = -(-len(text) // 24)
        cuts = np.cumsum([0] + [len(text) // k + (i < len(text) % k) for i in range(k)])
        margins = np.mean([np.array(kernel(text[a:b])) @ duals for a, b in zip(cuts, cuts[1:], strict=False)], axis=0)
        assert lang == list(spoken)[int(margins.argmax())] and abs(score - np.clip((1 + margins.max()) / 2, 0, 1)) < 1e-3


def test_language_sample_is_bounded(spark, monkeypatch):
    """An id that holds most rows neither fills the sample nor brings all its rows to the driver."""
    taken = []
    monkeypatch.setattr(language, "train", lambda texts: taken.append(texts))
    rows = [(i, f"text {i}", "ab"[i % 2]) for i in range(200)]
    hot = [(8, f"hot {i}", "a") for i in range(400)] + [(8, "same", "a")] * 400
    language.fit(spark.createDataFrame(rows + hot, "doc_id long, text string, lang string"), rows=40)
    assert 10 <= len(taken[0]) <= 80 and {lang for _, lang in taken[0]} == {"a", "b"} and sum(t == "same" for t, _ in taken[0]) <= 1


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    rows = toxicity.score_toxicity(docs, lexicon).filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    right = np.mean([r["predicted"] == r["toxic"] for r in rows])
    assert right > 0.97
    assert toxicity.fold("1D1ot, Ｉdïоt") == "idiot  idiot" and "trash" in toxicity.fold("tr@sh!").split()
    tagged = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(odd(spark), toxicity.fit(odd(spark), tagged)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(empty(spark), toxicity.Lexicon()).count() == 0
    assert toxicity.drop_toxic(odd(spark), lexicon).columns == odd(spark).columns


def test_toxicity_is_learned_as_in_memory(spark):
    """The lexicon and every score of a table against the same rules on lists."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    texts, known = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["toxic"] for r in labels.collect()}
    known = {i: k for i, k in known.items() if zlib.crc32(str(i).encode()) % 5 and k in (0, 1)}
    lists = {k: sorted(" ".join(toxicity.folded_words(texts[i])) for i in known if known[i] == k and i in texts) for k in (0, 1)}
    want, got = toxicity.learn(lists[1], lists[0], np.mean(list(known.values()))), toxicity.fit(docs, labels)
    assert got.weights == want.weights and got.exceptions == want.exceptions and np.allclose(got.model, want.model)
    built = want.automaton()
    for r in toxicity.score_toxicity(docs, got).collect():
        assert abs(r["score"] - want.score(toxicity.features(built, toxicity.folded_words(texts[r["doc_id"]]))[:2])) < 1e-9
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_scores_against_plain_matching(spark):
    """Every score of a table by comparing each word with each term, without the automaton or the library's folding."""
    import math
    import unicodedata

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()} | {-1: "", -2: "y0u 1d!ot", -3: "ÏDIØT\u0301 \u0456d\u0456\u043et"}

    def plain_words(text):
        out = []
        for i, c in enumerate(text):
            inside = 0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum()
            for d in unicodedata.normalize("NFKD", (toxicity.SIGNS.get(c, c) if inside else c).lower()):
                d = toxicity.LOOKALIKES.get(d, toxicity.DIGITS.get(d, d))
                out.append("i" if d == "l" else d if d.isalpha() else "" if unicodedata.category(d) in ("Mn", "Cf") else " ")
        return "".join(out).split()

    def plain_score(text):
        words = plain_words(text)
        best = {}
        for i, w in enumerate(words):
            near = {f"{a} {b}" for a, b in zip(words[max(0, i - 1) : i + 1], words[max(0, i - 1) + 1 : i + 2], strict=False)}
            if near.isdisjoint(lexicon.exceptions):
                fits = [(weight, t) for t, weight in lexicon.weights.items() if (f" {w} " == t if t.endswith(" ") else f" {w}".startswith(t))]
                best |= {i: max(fits)} if fits else {}
        one, two = min(sum({t: w for w, t in best.values()}.values()), 30), min(100 * sum(w for w, _ in best.values()) / len(words), 100) if words else 0
        return 1 / (1 + math.exp(-(lexicon.model[0] + lexicon.model[1] * one + lexicon.model[2] * two)))

    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, lexicon).collect()}
    assert lexicon.weights and set(got) == set(texts)
    assert max(abs(got[i] - plain_score(t)) for i, t in texts.items()) < 1e-9
    known = {r["doc_id"]: r["toxic"] for r in labels.filter("toxic in (0, 1)").collect()}
    outside = [i for i in known if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((plain_score(texts[i]) >= 0.5) == (known[i] == 1) for i in outside) >= 0.95 * len(outside)


def test_toxicity_of_an_id_on_many_texts(spark):
    docs = spark.createDataFrame([(1, f"vile word{i} x{i} y{i}") for i in range(60)] + [(2, f"kind thing{i} a{i} b{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, {1: 20, 0: 30})
    assert any("viie" in t for t in lexicon.weights) and toxicity.score_toxicity(docs, lexicon).count() == 120


def test_toxicity_exceptions_by_place():
    draw = random.Random(6)
    for _ in range(200):
        found = [(draw.randrange(60), "t", 1.0) for _ in range(20)]
        spans = [(a, a + draw.randrange(1, 9)) for a in (draw.randrange(60) for _ in range(6))]
        assert toxicity._outside(found, spans) == [x for x in sorted(found) if not any(a <= x[0] < b for a, b in spans)]


def test_toxicity_of_few_labels(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.remove_toxic(spark, docs, folder).collect()}
    bad, good = ({i for i, toxic in known.items() if toxic == k} for k in (1, 0))
    assert len(bad - kept) >= 0.7 * len(bad) and len(good & kept) >= 0.95 * len(good)


def test_toxicity_exceptions():
    toxic = [f"{w} you idiot there x{i}y{j}" for i in range(20) for j, w in enumerate(("hey", "oh"))]
    clean = [f"the trash can of house x{i}z{j}" for i in range(20) for j in range(2)] + [f"plain words only q{i}" for i in range(40)]
    toxic += [f"such trash people v{i}" for i in range(200, 260)]
    lexicon = toxicity.learn(toxic, clean, 0.3)
    built = lexicon.automaton()
    assert toxicity.features(built, "the idiot".split())[0] > 2
    if any(t.strip() == "trash" for t in lexicon.weights):
        assert "trash can" in lexicon.exceptions and toxicity.features(built, "the trash can".split())[0] == 0


# --- 4 -------------------------------------------------------------------------------------------------------


def test_surrogates(spark):
    text = "mail bob@mail.example.com and BOB@mail.example.com, card 4111 1111 1111 1111, ip 55.63.178.142, +1 (988) 555-2485 or (988) 555-2485; Mr John Smith, Frau Anna Müller, г-жа Иванова"
    docs = spark.createDataFrame([(1, text), (2, "write bob@mail.example.com"), (3, None), (4, ""), (5, "no data 12 3.4")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in surrogates.replace_entities(docs).collect()}
    new = got[1]["text"]
    for secret in ("bob@mail", "4111 1111 1111 1111", "55.63.178.142", "555-2485", "John", "Smith", "Müller", "Иванова"):
        assert secret.lower() not in new.lower()
    mail = re.search(r"mail (\S+) and (\S+),", new)
    assert mail[1] == mail[2].lower() and got[2]["text"] == f"write {mail[1]}"  # coreference
    card = re.search(r"card ([\d ]+),", new)[1]
    digits = [int(c) for c in card if c != " "]
    assert [len(x) for x in card.split()] == [4] * 4 and sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    phones = re.search(r"\+1 (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\) \d{3}-\d{4})", new)
    assert phones[1] == phones[2] and re.search(r"Mr \w+us \w+er, Frau \w+a \w+er, г-жа [а-я]+ова", new, re.IGNORECASE)
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == "no data 12 3.4" and got[1]["n_entities"] == 9
    other = surrogates.replace_entities(docs, key="another").filter("doc_id = 2").first()["text"]
    assert other != got[2]["text"]
    assert surrogates.replace_entities(odd(spark)).count() == len(ODD) and surrogates.replace_entities(empty(spark)).count() == 0


def test_surrogates_of_one_person_agree(spark):
    texts = [
        "Mr John Smith spoke.", "Dr John Smith and Mr J. Smith's dog. Then John Smith left, and Smith too.", "Prof. Dr. Anna-Maria O'Brien", "Mrs O'Brien wept; Anna went.", "Smith and John are in no name here.",
        "Mr May came in May; he may come.", "MR SMITH is no form of address, Mr SMITH is.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    new = [r["text"] for r in surrogates.replace_entities(docs).orderBy("doc_id").collect()]
    given, family = re.fullmatch(r"Mr (\w+us) (\w+er) spoke\.", new[0]).groups()
    assert new[1] == f"Dr {given} {family} and Mr {given[0]}. {family}'s dog. Then {given} {family} left, and {family} too."
    long = re.fullmatch(r"Prof\. Dr\. (\w+)-(\w+) (\w+)", new[2])
    assert new[3].split()[1].rstrip(";") not in (family, "O'Brien") and long[3] == re.match(r"Mrs (\w+)", new[3])[1]
    assert new[4] == texts[4] and new[5].endswith("came in May; he may come.") and new[6].endswith(f"Mr {family.upper()} is.")


def test_surrogates_of_words_alone_follow_their_own_text(spark):
    one = "Mr John Smith came. John left, and Smith too."
    others = [(2, "Mr John sat."), (3, "Ms Smith John ran. Smith slept; John woke."), (4, "Mr John John. John!"), (5, "Dr Smith and Mrs Smith; Smith"), (6, "Prof. May Lee and Mr Lee May: May, Lee")]
    got = []
    for docs in ([(1, one)], [(1, one), *others]):
        rows = surrogates.replace_entities(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        got.append({r["doc_id"]: r["text"] for r in rows})
    assert got[0][1] == got[1][1]
    given, family = re.fullmatch(r"Mr (\w+us) (\w+er) came\. \1 left, and \2 too\.", got[0][1]).groups()
    as_family = re.fullmatch(r"Mr (\w+) sat\.", got[1][2])[1]
    assert as_family != given and re.fullmatch(rf"Ms (\w+) {as_family} ran\. \1 slept; {as_family} woke\.", got[1][3])
    assert re.fullmatch(rf"Mr {given} {as_family}\. {given}!", got[1][4]) and got[1][5] == f"Dr {family} and Mrs {family}; {family}"
    assert re.fullmatch(r"Prof\. (\w+) (\w+) and Mr \w+ \w+: \1, \2", got[1][6])


def test_surrogates_of_names_of_a_table(spark):
    """One surrogate for each person everywhere; words alone as in the text's first name that has them; more texts change none."""
    import regex

    # The tables have no names, so texts that end with two by rule are put before theirs.
    draw, texts = random.Random(8), [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").take(200)]
    given, family = ["John", "Anna", "Maria", "Peter", "Lena-Sue", "Иван"], ["Smith", "Jones", "O'Brien", "John", "Maria", "Петров"]
    pick = lambda: (draw.choice(["Mr", "Mrs", "Dr", "Prof. Dr."]), draw.choice(given), draw.choice(family))
    rows = []
    for i, text in enumerate(texts):
        one, two = pick(), pick()
        rows.append((i, f"{' '.join(one)} saw {' '.join(two)}. {one[1]}, {two[2]} and {draw.choice(given)} left; {one[2]} stayed. {text[:300]}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    title = rf"{surrogates._TITLE}(?: {surrogates._TITLE}){{0,2}} (?=\p{{Lu}})"
    more = spark.createDataFrame([(10**6 + i, f"Mr {n} sat.") for i, n in enumerate(["John", "Anna", "Maria", "Peter", "Carlos", "Lena"])], "doc_id long, text string")
    new = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(docs).collect()}
    again = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(docs.union(more)).collect()}
    assert {i: t for i, t in again.items() if i < 10**6} == new
    persons, alone = {}, 0
    kinds = "|".join(f"(?:{p})" for p in surrogates.PATTERNS.values())
    for r in docs.filter("text is not null").collect():
        old, out, words = r["text"], new[r["doc_id"]], {}
        names = [m for m in regex.finditer(kinds, old) if regex.match(title, m[0])]
        low = set(regex.split(r"[^\p{L}'’]+", old))
        # What stands before the first name is the same in both texts as long as nothing else is replaced there.
        for name, found in zip(names, regex.finditer(surrogates.PATTERNS["person"], out), strict=False):
            parts, made = (regex.split("[ -]", regex.sub("^" + title, "", x)) for x in (name[0], found[0]))
            assert persons.setdefault(name[0], found[0]) == found[0] and len(parts) == len(made)
            for a, b in zip(parts, made, strict=True):
                words.setdefault(a.lower(), b.lower())
        bare = regex.sub(kinds, " ", old)
        for w, b in words.items():
            if len(w) > 2 and w not in low and regex.search(rf"(?<![\p{{L}}'’])(?i:{regex.escape(w)})(?![\p{{L}}'’])", bare):
                alone += 1
                assert b in out.lower()
    assert alone > 50 and len(persons) > 20 and len(set(persons.values())) == len(persons)


def test_surrogates_of_very_long_texts(spark):
    texts = ["x@" + "a." * 500_000 + "com", "a." * 500_000, "7" * 1_000_000, "Ab" * 500_000, "Mr A B C " * 110_000, "Mr Ab Cd Ef " * 20_000, "+1 23 " * 150_000, "a@b." * 250_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_entities"], r["text"]) for r in surrogates.replace_entities(docs).collect()}
    assert got[5][0] == 20_000 and all(got[i] == (0, texts[i]) for i in range(8) if i != 5)


def test_surrogates_are_distinct_and_agree_everywhere(spark):
    """Every document of a table against a plain version of what is found, and of what may stand for what."""
    import regex

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    title = regex.compile(rf"^{surrogates._TITLE}(?: {surrogates._TITLE}){{0,2}} (?=\p{{Lu}})")
    one_to_one: dict = {}
    for r in surrogates.replace_entities(docs).collect():
        text = texts[r["doc_id"]] or ""
        found = [(m.span(), next(k for k, p in surrogates.PATTERNS.items() if regex.fullmatch(p, m[0]))) for m in regex.finditer("|".join(f"(?:{p})" for p in surrogates.PATTERNS.values()), text)]
        people = {w.lower() for (a, b), k in found if k == "person" for w in regex.split("[ -]", title.sub("", text[a:b])) if len(w) > 2}
        people -= set(regex.split(r"[^\p{L}'’]+", text))
        taken = [False] * (len(text) + 1)
        for (a, b), _ in found:
            taken[a:b] = [True] * (b - a)
        found += [(m.span(), "person") for m in regex.finditer(surrogates._ALONE, text) if m[0].lower() in people and not taken[m.start()]]
        assert r["n_entities"] == len(found)
        at, rest = 0, r["text"] or ""
        gaps = []
        for (a, b), _ in sorted(found):
            gaps.append(text[at:a])
            at = b
        assert rest.startswith((gaps or [""])[0])
        for i, ((a, b), kind) in enumerate(sorted(found)):
            rest = rest[len(gaps[i]) :]
            until = gaps[i + 1] if i + 1 < len(gaps) else text[b:]
            new = rest[: rest.index(until)] if until else (rest[: b - a] if kind != "person" else rest)
            rest = rest[len(new) :]
            plain = (lambda x: re.sub(r"[^\d+]", "", x)) if kind in ("ssn", "card", "phone") else str.lower
            if kind != "person":
                pair = (kind, plain(text[a:b])), (kind, plain(new))
                assert one_to_one.setdefault(pair[0], pair[1]) == pair[1] and one_to_one.setdefault(pair[1] + ("new",), pair[0]) == pair[0]
                assert plain(new) != plain(text[a:b])
        assert rest == text[at:]


def test_cipher_is_one_to_one(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    got = [r[0] for r in rows.select(surrogates.cipher(F.col("s"), "k", "t")).collect()]
    assert sorted(got) == [f"{i:03}" for i in range(1000)]


def test_surrogates_of_distinct_numbers_are_distinct(spark):
    n = F.lpad(F.col("id").cast("string"), 5, "0")
    phones = spark.range(100_000).select(n.alias("n"), F.concat(F.lit("+49 "), n.substr(1, 1), F.lit(" "), n.substr(2, 2), F.lit(" "), n.substr(4, 2)).alias("entity"))
    new = [r[0] for r in phones.select(surrogates.surrogate(F.col("entity"), "k")).collect()]
    assert len(set(new)) == 100_000 and all(x.startswith("+49 ") for x in new) and sum(x[4] in "01" for x in new) == 20_000
    one, other = (spark.range(1).select(surrogates.surrogate(F.lit(x), "k")).first()[0] for x in ("+351 912 345 678", "+351912345678"))
    assert one.replace(" ", "") == other and other.startswith("+351")
    ibans = spark.range(100).select(F.concat(F.lit("DE"), F.lpad(F.col("id").cast("string"), 2, "0"), F.lit(" 3704 0044 0532 0130 00")).alias("entity"))
    new = {r[0].replace(" ", ""): r[1] for r in ibans.select(surrogates.surrogate(F.col("entity"), "k"), "entity").collect()}
    right = [own for x, own in new.items() if int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1]
    assert len(new) == 100 and "DE89 3704 0044 0532 0130 00" in right


def test_surrogates_that_meet_are_resolved(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "SYLLABLES", {"given": 1, "family": 1})
    names = sorted({f"{chr(65 + i % 26)}{chr(97 + i // 26 % 26)}{'xyz'[i % 3]}{'aeiou'[i // 700 % 5]}k" for i in range(2000)})
    docs = spark.createDataFrame([*((i, f"saw Mr {name} there") for i, name in enumerate(names)), (9000, "Mr McDonald"), (9001, "Mr Mcdonald")], "doc_id long, text string")
    entities = surrogates.occurrences(surrogates.found_in(docs)).select("entity").distinct()
    _, stems = surrogates.surrogates_of(entities, surrogates.KEY)
    assert stems.filter("retry > 0").count() > 20
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(docs).collect()}
    assert len({got[i] for i in range(len(names))}) == len(names) and got[9000] == got[9001] and not any(name in got[i] for i, name in enumerate(names))
    again = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(docs.repartition(3)).collect()}
    assert again == got


# --- 5 -------------------------------------------------------------------------------------------------------


def brute_links(texts, n=5, least=0.8):
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    links, root = collections.Counter(), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in texts}


def test_jaccard(spark):
    draw, texts = random.Random(5), {}
    for family in range(12):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.choice([4, 30, 90, 300]))]
        for _ in range(draw.randint(1, 14)):
            words = list(base)
            for _ in range(draw.randrange(0, 4)):
                words[draw.randrange(len(words))] = f"v{draw.randrange(10**6)}"
            texts[len(texts) + 1 + family * 100] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == brute_links(texts)


def test_jaccard_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 3)
    monkeypatch.setattr(jaccard, "LARGER", 2)
    draw = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = {}
    for i in range(40):
        words = list(base)
        words[draw.randrange(100)] = f"x{i}"
        texts[i] = " ".join(words[: 100 - i % 3])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == brute_links(texts)
    rows = {(r["doc_id"], r["class_id"], r["n_links"], r["n_texts"]) for r in jaccard.jaccard_classes(odd(spark)).collect()}
    assert rows == {(1, 1, 1, 0), (6, 1, 1, 0), (2, 2, 0, 0), (3, 3, 0, 0), (4, 4, 0, 0), (5, 5, 0, 0), (7, 7, 0, 0), (None, None, 0, 0)}
    kept = jaccard.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert jaccard.jaccard_classes(empty(spark)).count() == 0


def test_jaccard_of_chains_and_clashing_names(spark):
    # Neighbours are alike, ends are not: pairs without a common band must not be compared, links must not be lost.
    words = [f"w{i}" for i in range(700)]
    texts = {i: " ".join(words[i : i + 150]) for i in range(0, 500, 4)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == brute_links(texts)
    clashing = odd(spark).withColumns({c: F.lit(c) for c in ("a.b", "doc", "id", "hash", "__doc_id", "__text_hash", "kept", "class_id")})
    kept = jaccard.one_of_each(clashing)
    assert kept.columns == clashing.columns and kept.count() == 7
    # An id on two texts of a class, and one on two texts that differ in signs alone: one row of the class stays.
    twice = spark.createDataFrame([(1, words[0] + " b c d e f g"), (1, words[0] + " b, c d e f g"), (2, words[0] + " B c d e f g")], "doc_id long, text string")
    assert [r["doc_id"] for r in jaccard.one_of_each(twice).collect()] == [1]


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in touched}


def test_band_numbers():
    bands = jaccard.bands_for(0.8, jaccard.RECALL, jaccard.ROWS)
    assert 1 - (1 - 0.8**jaccard.ROWS) ** bands >= jaccard.RECALL > 1 - (1 - 0.8**jaccard.ROWS) ** (bands - 1)


# --- 6 -------------------------------------------------------------------------------------------------------

_KEYS = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_SCANNER = secrets.Scanner()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "password", "passwd", "api_key", "apikey", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGH12345678", "abcdef0123456789abcdef01", "é", "x", "-", "deadbeef", "\n"]), max_size=12))
def test_secrets(parts):
    text = "".join(parts)
    want = [(m.start(), m.end(), 0) for m in re.finditer(_KEYS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    want += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    data = text.encode()
    assert [s for s in secrets.code_points(data, _SCANNER.spans(data)) if s[2] < 3] == sorted(want, key=lambda s: (s[0], s[2]))


def test_places_in_code_points():
    text = "é token=abcdef12 ß中" * 300
    data = text.encode()
    spans = secrets.code_points(data, _SCANNER.spans(data))
    assert len(spans) == 300 and all(text[a:b] == "token=abcdef12" for a, b, _ in spans)


def test_secrets_on_odd_rows(spark):
    got = secrets.find_secrets(odd(spark)).collect()
    assert len(got) == len(ODD) and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    more = spark.createDataFrame([(1, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 9)], "doc_id long, text string")
    assert secrets.find_secrets(more).first()["spans"] == "private_key:0:31,forge:32:72"
    assert secrets.find_secrets(empty(spark)).count() == 0


# --- 7 -------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    """Words of each source: what is above three times its size is shared anew."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights, want, open_, rest = {s: i % 3 + 1 for i, s in enumerate(order)}, {}, set(order), sum(sizes.values())
    while True:
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return want | share
        for s in above:
            want[s] = 3 * sizes[s]
            rest -= want[s]
        open_ -= above


def plain_rates(docs, want, sizes, newton=True):
    """All multipliers at once, with the whole matrix; a rate for each (source, size)."""
    keys = [(s, n) for s, n in docs if n]
    w = np.array([n for _, n in keys], float)
    x = np.log2(w)
    mean = (w * x).sum() / w.sum()
    x = (x - mean) / ((w * x * x).sum() / w.sum() - mean**2) ** 0.5
    free = [s for s in want if want[s] < 3 * sizes[s]]
    columns = np.array([[float(s == f) for f in free] + [a, (a * a - 1) / 2] for (s, _), a in zip(keys, x, strict=True)])
    full = np.array([s not in free for s, _ in keys])
    goal = np.array([want[s] for s in free] + [0.0, 0.0])
    ridge = np.array([0.0] * len(free) + [mixing.RIDGE * w.sum()] * 2)
    m = np.array([np.log(want[s] / sizes[s]) for s in free] + [0.0, 0.0])
    rate = lambda: np.where(full, 3.0, np.minimum(3.0, np.exp(columns @ m)))
    for _ in range(200 if newton else 0):
        r = rate()
        slope = columns.T @ (w * r) - goal + ridge * m
        curve = (columns * (w * r * (~full & (r < 3)))[:, None]).T @ columns + np.diag(ridge + 1e-12)
        m -= np.clip(np.linalg.solve(curve, slope), -0.5, 0.5)
    r = rate()
    assert not newton or np.abs(columns.T @ (w * r) - goal + ridge * m).max() < 1e-6 * w.sum()
    return dict(zip(keys, r, strict=True))


def plain_copies(docs, rates_):
    """``docs`` has (id, source, size, text); copies by id."""
    out, groups = {}, collections.defaultdict(lambda: collections.defaultdict(list))
    for i, s, n, text in docs:
        hashed = hashlib.md5(f"{i}:{xxhash.xxh64_intdigest(text.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(text.encode(), 42) >> 63)}".encode()).hexdigest()
        bits = len(f"{n:b}")
        groups[s][bits * 16 + (n if bits <= 4 else n >> bits - 4)].append((hashed, n, i))
    for s, cells in groups.items():
        owed = 0.0
        for _, members in sorted(cells.items(), reverse=True):
            q = {i: int(rates_.get((s, n), 0.0) * mixing.UNIT + 0.5) for _, n, i in members}
            units, words = sum(q.values()), sum(q[i] * n for _, n, i in members)
            if not units:
                out |= dict.fromkeys(q, 0)
                owed += words / mixing.UNIT
                continue
            owed += words / mixing.UNIT
            whole = max(0, min(int(np.floor(owed * units / words + 0.5)), units * 3 // max(q.values())))
            owed -= whole * words / units
            at = 0
            for _, _, i in sorted(members):
                out[i] = whole * (at + q[i]) // units - whole * at // units
                at += q[i]
    return out


def test_mixing(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.choice([1, 5, 40, 300, draw.randrange(1, 2000)])), "en", f"s{i % 7}" if i % 11 else None, 1) for i in range(900)]
    rows += [(1000 + i, "w w", "en", "tiny", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    assert rows_of(mixing.mix(docs.repartition(7))) == sorted(map(tuple, got), key=repr)
    texts = {r[0]: r[1] for r in rows}
    names, by = {r[0]: r[3] for r in rows}, collections.defaultdict(list)
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] and r["size"] == len(next(x for x in rows if x[0] == r["doc_id"])[1].split())
        by[names[r["doc_id"]]].append(r)
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    want = plain_targets(sizes)
    assert want["tiny"] == 3 * sizes["tiny"] and all(r["copies"] == 3 for r in by["tiny"])
    for s, v in by.items():
        assert v[0]["source_size"] == sizes[s] and abs(v[0]["target"] - want[s]) < 1e-6 * sum(sizes.values())
        assert abs(sum(r["taken"] for r in v) - want[s]) <= 400
    plain = [(names[r["doc_id"]], r["size"]) for r in got]
    facts = docs.select(F.col("source").alias("__source"), mixing.word_count(F.col("text")).alias("__size")).groupBy("__source", "__size").agg(F.count("*").alias("__rows"))
    aims = spark.createDataFrame([(s, sizes[s], float(want[s])) for s in sizes], "__source string, __source_size long, __target double")
    found = {(r["__source"], r["__size"]): r["__q"] / mixing.UNIT for r in mixing.rates(facts, aims).collect()}
    exact, still = plain_rates(plain, want, sizes), plain_rates(plain, want, sizes, newton=False)
    assert max(abs(found[k] - exact[k]) for k in exact) < 2e-6 < 0.02 < max(abs(found[k] - still[k]) for k in exact)
    assert len({round(r, 4) for (s, _), r in found.items() if s == "s1"}) > 20  # each document's rate follows its length
    assert {r["doc_id"]: r["copies"] for r in got} == plain_copies([(r["doc_id"], names[r["doc_id"]], r["size"], texts[r["doc_id"]]) for r in got], found)
    out = mixing.mixed(odd(spark).withColumn("a.b", F.lit(1)).withColumn("doc", F.lit(2)))
    assert out.columns == [*odd(spark).columns, "a.b", "doc"] and mixing.mix(odd(spark)).count() == len(ODD)
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).filter("taken = 0 and target = 0").count() == len(rows)


@pytest.mark.parametrize("sizes", [[50] * 2000, [1, 9, 300], [7, 7, 7], [20] * 50 + [40] * 50])
def test_mixing_ends_in_few_steps(spark, monkeypatch, sizes):
    steps, state = [], mixing._State
    monkeypatch.setattr(mixing, "_State", lambda *x: steps.append(1) or state(*x))
    facts = spark.createDataFrame([("a", n, sizes.count(n)) for n in set(sizes)], "__source string, __size long, __rows long")
    aims = spark.createDataFrame([("a", sum(sizes), float(sum(sizes)))], "__source string, __source_size long, __target double")
    got = mixing.rates(facts, aims).collect()
    assert len(steps) <= 10 and abs(sum(r["__q"] * r["__size"] * r["__rows"] for r in got) / mixing.UNIT - sum(sizes)) < 1e-3 * sum(sizes)


def test_mixing_without_convergence_leaves_lengths_alone(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    facts = spark.createDataFrame([(s, n, 2) for s in "ab" for n in (1, 5, 70)], "__source string, __size long, __rows long")
    aims = spark.createDataFrame([("a", 152, 100.0), ("b", 152, 204.0)], "__source string, __source_size long, __target double")
    got = {(r["__source"], r["__size"]): r["__q"] / mixing.UNIT for r in mixing.rates(facts, aims).collect()}
    assert all(abs(v - {"a": 100, "b": 204}[s] / 152) < 1e-5 for (s, _), v in got.items())


def test_mixing_splits_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 4)
    rows = [(None, f"w{i} x y z", "en", "a", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sum(r["taken"] for r in mixing.mix(docs).collect()) == 1600
    hashed = docs.select(F.md5(F.concat_ws(":", F.lit(""), F.xxhash64("text").cast("string"))).substr(1, 2).alias("part"))
    assert hashed.distinct().count() > 100


def test_mixing_ranks_many_sources(spark):
    sources = spark.range(5000).select(F.when(F.col("id") < 4999, F.concat(F.lit("s"), F.col("id"))).alias("__source"), F.lit(1).alias("x")).repartition(5)
    got = {r["__source"]: r["__rank"] for r in mixing.ranked(sources).collect()}
    assert got == {s: i for i, s in enumerate([*sorted(f"s{i}" for i in range(4999)), None])}


# --- 8, 10 ---------------------------------------------------------------------------------------------------


def test_licenses(spark):
    draw = random.Random(8)
    vocabulary = [w.decode() for t in licenses.TEMPLATES for w in t.words] + ["foo", "bar", "baz"]
    texts = {i: " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 150))) for i in range(60)}
    texts |= {100 + i: f"intro {t.text} outro" for i, t in enumerate(licenses.TEMPLATES)}
    texts |= {200 + i: " ".join(w for w in f"intro {t.text} outro".split() if draw.random() > 0.1) for i, t in enumerate(licenses.TEMPLATES)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in licenses.find_licenses(docs).collect():
        words = words_of(texts[r["doc_id"]])
        base, labels, places = set(), set(), []
        for t in licenses.TEMPLATES:
            if t.phrase:
                at = [i for i in range(len(words)) if words[i : i + len(t.words)] == t.words]
                places += at
                base |= {t.label} if at else set()
            elif any(len(set(t.tokens) & set(words[b : b + 2 * t.stride])) >= t.needed for b in range(0, len(words), t.stride)):
                labels.add(t.label)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(base)) and r["labels"] == ",".join(sorted(base | labels))
    assert licenses.find_licenses(odd(spark)).count() == len(ODD) and licenses.find_licenses(empty(spark)).count() == 0


@pytest.mark.parametrize("group_bytes", [1 << 20, 60])
def test_contamination(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(decontaminate, "PIECE", 3 if group_bytes == 60 else 2000)
    draw = random.Random(4)
    items = [(i, " ".join(f"t{draw.randrange(6)}" for _ in range(draw.choice([0, 3, 13, 20])))) for i in range(8)] + [(3, "another text of item three"), (None, "nothing at all"), (99, None)]
    texts = {i: " ".join(f"t{draw.randrange(6)}" for _ in range(draw.randint(0, 80))) + (" " + (items[i % 8][1] or "")).upper() for i in range(40)}
    docs = spark.createDataFrame([*texts.items(), (500, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.find_contamination(docs, bench, group_bytes=group_bytes).collect():
        words, hit, found = words_of(texts.get(r["doc_id"])), set(), set()
        for item, text in items:
            own = words_of(text)
            if item is None or not own:
                continue
            n = min(13, len(own))
            for w in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}:
                for p in range(len(words) - n + 1):
                    if tuple(words[p : p + n]) == w:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(words), len(hit), len(found))
        assert r["items"] == sorted(found) and r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(words))
        if r["doc_id"] in texts:
            covered = [w for a, b in zip(r["hit_starts"], r["hit_ends"], strict=True) for w in words_of(texts[r["doc_id"]][a:b])]
            assert covered == [words[p] for p in sorted(hit)]
    assert decontaminate.find_contamination(odd(spark), bench).count() == len(ODD)
    assert decontaminate.find_contamination(empty(spark), bench.filter("false")).count() == 0
    bad = {r["doc_id"] for r in decontaminate.find_contamination(docs, bench).filter("contaminated").collect()}
    kept = decontaminate.drop_contaminated(docs, bench, group_bytes=group_bytes)
    assert {r["doc_id"] for r in kept.collect()} == {*texts, 500} - bad


# --- 9 -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("scale", [1, 256, 1 << 24, 1 << 29])
def test_topk(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "GROUP_BYTES", 1500)
    draw = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in draw.integers(-3, 4, 4) / 4]) for i in range(120)] + [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf")] * 4), (204, [1.0, 2.0]), (300, [1.0, 2.0]), (None, [1.0] * 4), (7, [0.5] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = collections.defaultdict(list)
    for r in topk.search(vectors, F.col("vec_id") % 50 == 0, scale=scale).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, v in ((i, v) for i, v in good if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v)))[:5]
        assert got.pop(q, []) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert not got
    assert topk.search(vectors.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_very_large_components(spark):
    rows = [(0, [1e9, -1e9, 3e8]), (50, [1e300, 1.0, 0.0]), (1, [1e9, 1e9, 1e9]), (2, [1e308, 1e308, -1e308]), (3, [-1e300, 0.0, 0.0]), (4, [0.5, 0.25, 1e-300]), (5, [2e9, -2e9, 6e8])]
    whole = {i: [int(min(max(np.floor(np.float64(256) * x), -np.finfo(float).max), np.finfo(float).max)) for x in v] for i, v in rows if max(map(abs, v)) < 1e305} | {2: [int(np.finfo(float).max)] * 2 + [-int(np.finfo(float).max)]}
    got = collections.defaultdict(list)
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 50):
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], w, strict=True)), -(1 << 63)), (1 << 63) - 1), i) for i, w in whole.items() if i != q)
        assert got[q] == [(i, -s) for s, i in scores[:5]]


# --- pipeline ------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = rows_of(corpus_pipeline.run(spark, folder))
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    unique = stages["near_duplicates"](spark, clean, folder)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert {r["doc_id"] for r in unique.collect()} == {root for root, _ in brute_links(texts).values()}
    assert clean.columns == unique.columns == docs.columns
    fit = stages["decontamination"](spark, unique, folder)
    mixed = stages["mixing"](spark, fit, folder)
    assert mixed.columns == docs.columns and {r[0] for r in got} == {r["doc_id"] for r in mixed.collect()} and len(got) == mixed.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.filter("false"), folder)
        assert out.count() == 0, name
        assert stage(spark, odd(spark), folder).count() >= 0
