"""The ten operators and the pipeline on small tables: odd rows, and brute force where SQL has no say."""

import hashlib
import json
import math

import numpy as np
import pytest

from tagloom.llm import chat, decontam, langid, packing
from tagloom.llm.components import components
from tagloom.llm.ngramjoin import near_duplicates
from tagloom.llm.substr import repeats
from tagloom.llm.textkit import EXACT, FOLDED, GRAM_WIDE, Texts, pack_ints, pack_keys, unpack_ints, unpack_keys
from tagloom.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score double"
WORDS = [f"w{i}" for i in range(400)]


def text(a, n, step=1):
    return " ".join(WORDS[(a + i * step) % 400] for i in range(n))


def rows():
    base = text(0, 60)
    near = base.replace("w30 ", "changed ")
    return [
        (1, base),
        (2, base),
        (3, near),
        (4, text(100, 60)),
        (5, None),
        (6, ""),
        (7, " \t\n"),
        (8, "one two"),
        (9, "One TWO"),
        (None, base),
        (4, text(100, 60)),
        (10, text(200, 20) + "\n" + text(0, 20)),
        (11, "É" * 30 + " naïve " + text(300, 3)),
        (12, "x" * 200_000),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 0.5) for i, t in rows()], DOCS)


def split(t, fold=False):
    b = (t or "").encode()
    return (b.lower() if fold else b).split()


def test_textkit():
    t = Texts([b"A b\tA", b"", b"a b a"], FOLDED)
    assert t.n_words.tolist() == [3, 0, 3] and t.key[0] == t.key[2] == t.key[3] and t.key[0] != t.key[1]
    assert Texts([b"A a"], EXACT).key[0] != Texts([b"A a"], EXACT).key[1]
    keys, inside = t.grams(3)
    assert inside.tolist() == [True, False, False, True] and keys[0] == keys[3]
    big = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (unpack_keys(pack_keys(big)) == big).all() and unpack_ints(pack_ints(np.array([-5, 2**40]))).tolist() == [-5, 2**40]
    long = ("word " * 400_000).encode()
    assert len(set(Texts([long], EXACT).key.tolist())) == 1
    # words that collide under polynomials modulo 2**64, and words longer than the table of places
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    odd = [bytes(97 + b for b in bits), bytes(98 - b for b in bits), b"x" * 200, b"x" * 201, b"x" * 64 + b"y" + b"x" * 135, b"y" + b"x" * 199]
    assert len(set(Texts(odd, FOLDED).key.tolist())) == len(odd)
    assert (t.grams(3)[0] != t.grams(3, GRAM_WIDE)[0]).all()


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 11), (11, 12)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links, Workspace(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8}
    assert components(links.limit(0), Workspace(spark, "t")).count() == 0


def brute_components(items):
    def sets(t):
        w = split(t, True)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    s = [sets(t) for _, t in items]
    root = list(range(len(items)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(items)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(items):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s[k]), least.get(find(k), i)) for k, (i, _) in enumerate(items)), key=repr)


def test_near_duplicates(spark, docs):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == brute_components(rows())
    assert near_duplicates(docs.limit(0)).count() == 0


def test_crowds_of_near_copies(spark):
    rng = np.random.default_rng(7)
    items = []
    for i in range(260):
        w = [f"v{(i % 3) * 1000 + k}" for k in range(80)]
        for k in rng.choice(80, rng.integers(0, 5), replace=False):
            w[k] = f"r{rng.integers(1e9)}"
        items.append((i, " ".join(w)))
    frame = spark.createDataFrame(items, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(frame).collect()]
    assert sorted(got, key=repr) == brute_components(items)


def brute_repeats(items):
    first = {}
    for i, t in items:
        w = split(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), set()).add(math.inf if i is None else i)
    out = []
    for i, t in items:
        w, me = split(t), math.inf if i is None else i
        gone = set()
        for k in range(len(w) - 12):
            if min(first[tuple(w[k : k + 13])]) < me:
                gone |= set(range(k, k + 13))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, docs):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in repeats(docs).collect()]
    assert sorted(got, key=repr) == brute_repeats(rows())
    same = [(1, "a " * 40), (2, "a " * 20), (3, text(0, 13)), (4, text(399, 15))]
    frame = spark.createDataFrame(same, "doc_id long, text string")
    out = repeats(frame).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out), key=repr) == brute_repeats(same)
    assert {r["doc_id"]: r["removed"] for r in out}[4] == [1, 13]
    spaced = spark.createDataFrame([(1, text(0, 13)), (2, "\n a\t" + text(0, 13).replace(" ", "\n") + "\n\n  b c\n"), (3, text(0, 13) + "\n"), (4, " \n"), (5, None)], "doc_id long, text string")
    assert [r["kept_text"] for r in repeats(spaced, layout=True).orderBy("doc_id").collect()] == [text(0, 13), "\n a\tb c\n", "\n", " \n", ""]
    assert repeats(docs.limit(0)).count() == 0


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_tokens_of_words_are_those_of_texts():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(tokenizer()), packing.WordTokens(tokenizer())
    odd = ["", " ", "Don't stop!! 3rd <|endoftext|> naïve Straße İ ŉ ΑΣ. é  x", "ab12cd... (x)y_z's", "word,," * 50]
    for t, ids in zip(odd, own.encode([t.encode() for t in odd])):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing(spark, docs):
    got = packing.pack(docs, tokenizer(), capacity=32).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    want = []
    for i, x in rows():
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want += [(i, p, s, len(ids[s : s + 32]), np.array(ids[s : s + 32], "<u4").tobytes()) for p, s in enumerate(range(0, len(ids), 32))]
    mine = [(None if math.isnan(a) else int(a), b, c, d, bytes(e)) for a, b, c, d, e in got[["doc_id", "piece", "start", "length", "ids"]].itertuples(index=False)]
    assert sorted(mine, key=repr) == sorted(want, key=repr)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 32 and g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    assert packing.pack(docs.limit(0), tokenizer()).count() == 0


def test_packing_plan_is_tight():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 101, 3000), minlength=101).tolist()
    segments, n = packing.plan(counts, 100)
    total = sum(i * c for i, c in enumerate(counts))
    assert n <= 1.01 * total / 100 + 1
    placed = np.zeros(101, int)
    for length, _, times, _, _ in segments:
        placed[length] += times
    assert placed.tolist() == counts
    assert packing.plan([0] * 11, 10) == ([], 0) and packing.plan([0, 0, 0, 4], 3)[1] == 4


def test_language_id(spark, docs):
    train = spark.createDataFrame([("the house of the people and the water " * 20, "en"), ("das Haus der Leute und das Wasser nicht " * 20, "de"), (None, "fr"), ("x", None), ("  ", "es")], "text string, lang string")
    d = langid.learn(train)
    assert set(d) == {"de", "en"}
    asked = spark.createDataFrame([(1, "the water of the house"), (2, "der Leute Haus und Wasser"), (3, None), (4, "123 !!"), (5, ""), (None, "the house of the people and the water")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(asked, d).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, None)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not got[4]["accepted"] and got[1]["accepted"]
    assert langid.identify(docs, d).count() == len(rows()) and langid.identify(docs.limit(0), d).count() == 0
    assert langid.identify(asked, {}).filter("lang_pred <> 'und'").count() == 0


def speech(rng, syllables, size):
    """Words of a made-up language, ``size`` bytes of them."""
    words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(3000)]
    return " ".join(words[i] for i in (3000 * rng.random(size // 3) ** 3).astype(int).tolist())[:size]


def tongues(rng):
    return {"a": list(rng.choice([x + y for x in "bdfgklm" for y in "aeiou"], 25, replace=False)), "b": [x + y for x in "nprstvz" for y in "aeiou"]}


def test_language_of_long_texts():
    rng = np.random.default_rng(8)
    kinds = tongues(rng)
    texts = {}
    for lang, syllables in kinds.items():
        own = np.random.default_rng(11)
        texts[lang] = speech(own, syllables, 1_000_000)
    rank = langid.scorer({lang: t[:32_768].encode() for lang, t in texts.items()})
    gaps = [(lambda r: (r[0][1], r[1][0] - r[0][0]))(rank(langid.letters(texts["a"][100_000 : 100_000 + n]))) for n in (200_000, 800_000)]
    assert [g[0] for g in gaps] == ["a", "a"] and gaps[1][1] > 3 * gaps[0][1]
    mixed = langid.letters(texts["b"][100_000:250_000] + " " + texts["a"][100_000:900_000])
    assert rank(mixed)[0][1] == "a"
    parts = list(langid.chunks(mixed))
    assert b"".join(parts) == mixed and max(map(len, parts)) <= langid.CHUNK and list(langid.chunks(b"")) == [b""]


def test_every_sample_reaches_the_dictionary(spark):
    texts = [("boilerplate opens every text " * 40 + " ".join(["mark" + "".join(chr(97 + int(c)) for c in str(i))] * 3000), "en") for i in range(300)]
    d = langid.learn(spark.createDataFrame(texts, "text string, lang string"))["en"]
    marks = {w for w in d.split() if w.startswith(b"mark")}
    assert len(marks) > 50 and len(d) <= langid.DICTIONARY_BYTES
    assert langid.shares([b"aaaa", b"b", b"cccc"], 9) == [b"aaa", b"b", b"ccc"]


def test_language_margin_at_any_length(spark):
    rng = np.random.default_rng(8)
    kinds = tongues(rng)
    texts = {lang: speech(np.random.default_rng(11), syllables, 4_000_000) for lang, syllables in kinds.items()}
    d = {lang: t[:32_768].encode() for lang, t in texts.items()}
    letters = list("abcdefghijklmnopqrstuvwxyz")
    junk = lambda n: " ".join("".join(rng.choice(letters, rng.integers(2, 11))) for _ in range(n // 7))
    clean = [(i, texts["ab"[i % 2]][1_000_000 : 1_000_000 + n]) for i, n in enumerate((300, 300, 2_000, 2_000, 30_000, 30_000, 1_500_000, 1_500_000))]
    odd = [(100 + i, junk(n)) for i, n in enumerate([1_000] * 20 + [1_900] * 20 + [200_000])]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(clean + odd, "doc_id long, text string"), d).collect()}
    assert all(got[i]["accepted"] and got[i]["lang_pred"] == "ab"[i % 2] for i, _ in clean)
    assert not any(got[i]["accepted"] for i, _ in odd)


def test_chat_round_trip():
    for said in ("", "\\", "### a: b </turn>\n", "\\### Assistant: </turn> ok", "\\\\#<:", "x\ny"):
        for role in ("user", "a: b", "#"):
            whole = chat.render(role, said)[0] + chat.render("assistant", said)[0]
            assert list(chat.parse(whole)) == [(role, said), ("assistant", said)]


def test_chat_folds_events(spark):
    log = [
        (1, 0, 1, "message", "user", "hi"),
        (1, 1, 2, "message", "assistant", ""),
        (1, 1, 3, "delta", None, "he"),
        (1, 1, 4, "delta", None, "llo"),
        (1, 2, 5, "message", "user", "gone"),
        (1, 1, 6, "regenerate", None, None),
        (1, 1, 7, "delta", None, "bye"),
        (1, 2, 8, "message", "user", "kept"),
        (2, 0, 1, "message", "user", "a"),
        (2, 0, 2, "edit", None, "b"),
        (2, 0, 1, "message", "user", "a"),
        (None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    texts = {}
    for r in chat.format_chats(frame).collect():
        texts.setdefault(r["conv_id"], []).append((r["start"], r["formatted"]))
    say = lambda c: list(chat.parse("".join(t for _, t in sorted(texts[c]))))
    assert say(1) == [("user", "hi"), ("assistant", "bye"), ("user", "kept")]
    assert ("user", "b") in say(2) and say(None) == [("", "")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 3 and got[1]["loss_sha256"] == hashlib.sha256(b"bye").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nbye\nuser\nkept\n").hexdigest()
    assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0


def test_smith_waterman():
    def brute(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max()

    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 15))
        assert decontam.smith_waterman(a, b)[0] == (brute(a, b) if len(a) and len(b) else 0)


def test_decontamination(spark, docs):
    item = text(100, 30, 3)
    w = item.split()
    edited = " ".join(x for i, x in enumerate(w) if i % 7) + " more"
    texts = [(1, text(0, 50) + " " + item + " " + text(50, 50)), (2, "a b. " + edited.upper().replace(" ", "!! ")), (3, text(0, 100)), (4, None), (5, ""), (None, item)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "two words")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.matches(frame, items).collect()}
    short = spark.createDataFrame([(1, "x one y"), (2, "two words"), (3, "two such words"), (4, "words two"), (5, "One. Two, words!")], "doc_id long, text string")
    brief = spark.createDataFrame([(8, "one"), (9, "two words"), (10, "!"), (11, None)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["start_word"], r["end_word"]) for r in decontam.matches(short, brief).collect()) == [(1, 8, 1, 2), (2, 9, 0, 2), (5, 8, 0, 1), (5, 9, 1, 3)]
    assert (got[2]["start_word"], got[2]["end_word"]) == (2, 2 + len(edited.split()) - 1)
    assert set(got) == {1, 2, None} and got[1]["score"] == 1.0 and 0.5 < got[2]["score"] < 1 and got[1]["start_word"] == 50
    assert decontam.matches(frame, items.limit(0)).count() == 0 and decontam.matches(docs.limit(0), items).count() == 0


def test_decontamination_finds_all_that_reach_the_threshold():
    rng = np.random.default_rng(6)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    word = lambda: str(rng.choice(common if rng.random() < 0.5 else rare))

    def edited(words, rate):
        out = []
        for w in words:
            kind = rng.random() / rate
            out += [w] if kind >= 1 else [word()] if kind < 0.4 else [] if kind < 0.7 else [word(), w]
        return out

    items = [[word() for _ in range(int(rng.integers(3, 40)))] for _ in range(40)]
    copies = [[x if i % 3 else f"new{i}" for i, x in enumerate(w)] for w in items] + [[y for x in w for y in (x, "put")] for w in items]
    copies += [edited(w, rate) for w in items for rate in (0.1, 0.3, 0.45, 0.6, 0.75)]
    texts = [[word() for _ in range(int(rng.integers(0, 80)))] + w + [word() for _ in range(int(rng.integers(0, 80)))] for w in copies]
    t = Texts([" ".join(w).encode() for w in texts], EXACT)
    for threshold in (0.4, 0.7):
        for scale in (1, 1_000):
            of = decontam.Items([(k, " ".join(w).encode()) for k, w in enumerate(items)], threshold)
            freq = np.zeros(len(of.vocabulary.table), np.int64)
            for _, _, at in decontam._spots(t, of.vocabulary, of.apart):
                freq += scale * np.bincount(at, minlength=len(freq))
            of.choose(freq)
            got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam._align(of, list(range(len(texts))), t, threshold)}
            if scale == 1:
                first = got
                want = {}
                for d in range(len(texts)):
                    for k, w in enumerate(of.words):
                        share = decontam.smith_waterman(w, t.key[t.first[d] : t.first[d + 1]])[0] / (2 * len(w))
                        if share >= threshold:
                            want[d, k] = share
            assert got == want == first and len(got) > 50
            if threshold == 0.4:
                assert all((d, d % 40) in got for d in range(80) if len(items[d % 40]) >= 12)


def test_decontamination_without_an_intact_trigram(spark):
    item = text(100, 30, 3)
    third = " ".join(x if i % 3 else f"new{i}" for i, x in enumerate(item.split()))
    frame = spark.createDataFrame([(1, text(0, 50) + " " + third + " " + text(50, 50)), (2, text(0, 100))], "doc_id long, text string")
    got = decontam.matches(frame, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [r["doc_id"] for r in got] == [1] and got[0]["score"] >= decontam.THRESHOLD


def test_stages_keep_columns_and_work_on_all(spark, docs, tmp_path):
    import corpus_pipeline

    items = spark.createDataFrame([(1, text(300, 30, 7))], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        now = Workspace(spark, "t").write(out, "out")
    ids = sorted((r["doc_id"] for r in now.select("doc_id").collect()), key=repr)
    assert None not in ids and 2 not in ids and 3 not in ids and ids.count(4) == 1 and 5 not in ids and 1 in ids
    assert corpus_pipeline.STAGES[4][1](spark, now, str(tmp_path)).count() >= len(ids)
    assert all(stage(spark, docs.limit(0), str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_sql_of_ops(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are absent")
    duckdb = pytest.importorskip("duckdb")
    from tagloom.llm import queries as q

    con = duckdb.connect()
    for name in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in q.SQL.items():
        want, got = con.execute(sql).df(), q.QUERIES[name](spark, sf).toPandas()
        columns = sorted(want.columns)
        as_rows = lambda f: sorted(json.dumps(r, default=str) for r in f[columns].astype(object).values.tolist())  # noqa: B023, E731
        assert sorted(got.columns) == columns and as_rows(got) == as_rows(want), name
