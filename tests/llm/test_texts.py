"""Operators on texts: odd rows, empty tables, and brute force on small tables."""

import base64
import collections
import math
import random
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import fertility, jaccard, language, lm, mixing, packing, pieces, sharding, toxicity
from tidewell.llm.common import fold

SF = "/root/testdata/sf0.001"
BYTE, WORD, PIECE = (pieces.vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def words(text):
    return (text or "").encode().split()


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in rows(df)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_empty_tables(spark, empty, labels):
    learn = fold("doc_id", 5) != 0
    for out in (
        toxicity.score(empty, labels.limit(0), learn),
        language.identify(empty, learn),
        pieces.token_counts(empty, BYTE),
        fertility.quality(empty, BYTE, PIECE),
        packing.pack(empty, WORD),
        lm.likelihood(empty, fold("doc_id", 7) == 2),
        mixing.mix(empty),
        sharding.shard(empty),
        jaccard.near_texts(empty),
    ):
        assert out.collect() == []


# --- toxicity


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, None), (7, 0), (99, 1)], "doc_id long, toxic int")
    out = toxicity.score(odd, labels, fold("doc_id", 5) != 0)
    got = rows(out)
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1  # no features: the bias


def test_toxicity_clean_keeps_columns(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.clean(odd, labels, fold("doc_id", 5) != 0)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_toxicity_held_out_accuracy(spark, docs):
    """Texts with marked words are found, also where the mark is only the beginning of a word."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts, marks = [], []
    for i in range(700):
        own = [rng.choice(vocabulary) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            own[::8] = [rng.choice(["zzvile", "zzgrim"]) + rng.choice("abcdefgh") for _ in own[::8]]
        texts.append((i, " ".join(own)))
        if i % 7 < 4:
            marks.append((i, int(toxic)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    m = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = rows(toxicity.score(d, m, fold("doc_id", 5) != 0))
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]) > 0.95


def test_corrected_risk_goes_against_a_negative_part():
    """With a prior that is too high the clean part turns negative; the fit still separates."""
    rng = np.random.default_rng(0)
    texts = [b"bad " * (i < 60) + b" ".join(b"w%d" % k for k in rng.integers(0, 30, 12)) for i in range(300)]
    table = toxicity.Table(texts, np.arange(300) < 40, 2, 0.9)
    positive = np.arange(300) < 40
    w, bias = toxicity.fit(table, positive, 0.5, steps=150, lanes=40, rate=50.0, decay=1e-6, seed=1)
    x = table.scores(w, np.arange(300))[0] + bias
    assert x[:60].mean() > x[60:].mean() + 1


# --- language


def test_language_odd_rows(odd):
    got = rows(language.identify(odd, fold("doc_id", 5) != 0, steps=30))
    assert len(got) == odd.count()
    for r in got:
        und = r["doc_id"] in (3, 4, 5, 6)
        assert (r["lang_pred"] == "und") == und and 0 <= r["score"] <= 1
    assert language.recognised(odd, fold("doc_id", 5) != 0, steps=5, least=0.0).columns == odd.columns


def test_language_held_out_accuracy(docs):
    out = language.identify(docs, fold("doc_id", 5) != 0).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() >= 0.9 * out.count()


def test_word_windows_equal_reading_every_byte():
    net = language.ByteNetwork(["a", "b"], hidden=4)
    text = [b"hello", b"a", b"x" * 60]
    sums = language.word_sums(net, text)
    for w, s in zip(text, sums, strict=True):
        want = np.zeros(2)
        for part in language.windows(w):
            want += net.label(np.frombuffer(part, np.uint8)[:, None])[0]
        assert np.allclose(s[:2], want, atol=1e-4) and s[2] == sum(map(len, language.windows(w)))


# --- token counts and fertility


def fuzz(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "é", " ", " ", "  ", "\n", "\t", "'s", "1", "½", "!!", "<|endoftext|>", "　", "\x1c", "౜", "日", "\xa0", " x", "Σ", "İ", "é"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, docs, odd):
    tokeniser = pieces.load(BYTE)
    texts = [(i, t) for i, t in enumerate(fuzz(2000, 1))] + [(10_000 + i, r["text"]) for i, r in enumerate(docs.limit(100).collect())]
    texts += [(20_000 + i, r["text"]) for i, r in enumerate(odd.collect())]
    got = by_id(pieces.token_counts(spark.createDataFrame(texts, "doc_id long, text string"), BYTE))
    for i, t in texts:
        assert got[i]["n_tokens"] == len(tokeniser.encode(t or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((t or "").encode())


def base_of(text):
    """The base columns, plainly."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if x.encode().strip()]
    where = collections.defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    inside = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_base_columns(spark, docs, odd):
    texts = [(i, r["text"]) for i, r in enumerate(docs.collect())] + [(10_000 + i, r["text"]) for i, r in enumerate(odd.collect())]
    texts += [(20_000 + i, t) for i, t in enumerate(fuzz(200, 2))]
    got = by_id(fertility.quality(spark.createDataFrame(texts, "doc_id long, text string"), BYTE, PIECE))
    for i, t in texts:
        r = got[i]
        want = base_of(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_quality_measures_and_bands(spark):
    import sentencepiece

    clean = "The committee will meet again on Monday to discuss the new budget for the city library and its many branches this year"
    noise = " ".join("\U0001fa70" * 3 for _ in range(25))
    same = "go " * 19 + "on"
    d = spark.createDataFrame([(1, clean), (2, noise), (3, same)], "doc_id long, text string")
    got = by_id(fertility.quality(d, BYTE, PIECE, max_repeat_percent=200))
    tok, sp = pieces.load(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids = [i for w in clean.split() for i in tok.encode(" " + w, add_special_tokens=False).ids]
    share = np.array(list(collections.Counter(ids).values())) / len(ids)
    assert math.isclose(got[1]["chars_per_token"], sum(map(len, clean.split())) / len(ids))
    assert math.isclose(got[1]["entropy"], float(-(share * np.log2(share)).sum()))
    found = [i for w in noise.split() for i in sp.encode(w)]
    assert math.isclose(got[2]["byte_share"], sum(sp.is_byte(i) for i in found) / len(found))
    assert got[1]["kept"] and not got[2]["in_bands"] and not got[3]["in_bands"]


GARBAGE = {
    "letters": lambda rng, n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n)),
    "hex": lambda rng, n: "".join(rng.choice("0123456789abcdef") for _ in range(n)),
    "digits": lambda rng, n: "".join(rng.choice(string.digits) for _ in range(n)),
    "base64": lambda rng, n: base64.b64encode(rng.randbytes(n)).decode(),
    "broken": lambda rng, n: rng.choice(["größe", "être", "über", "élève", "déjà", "ça", "año"]).encode().decode("latin1") + str(rng.randrange(9)),
}


def test_quality_rejects_strings_without_language(spark):
    """Random and wrongly decoded strings go, clean texts of every language stay."""
    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    bad = [(-1 - i, " ".join(make(rng, rng.randint(3, 12)) for _ in range(200)), kind) for i, (kind, make) in enumerate(GARBAGE.items())]
    got = rows(fertility.quality(docs.union(spark.createDataFrame(bad, docs.schema)), BYTE, PIECE))
    assert {r["doc_id"] for r in got if r["doc_id"] < 0 and r["in_bands"]} == set()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    own = collections.defaultdict(list)
    for r in got:
        if r["doc_id"] >= 0 and not r["base_failed"]:
            own[lang[r["doc_id"]]].append(r["kept"])
    assert len(own) >= 4 and all(sum(k) >= 0.97 * len(k) for k in own.values())


def test_quality_bands_equal_counts_by_hand(spark):
    """Learned bands against quantiles of sorted values."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in rows(fertility.quality(docs, BYTE, PIECE)) if not r["base_failed"]]
    cells = collections.defaultdict(list)
    for r in got:
        cells[r["script"], r["n_words"].bit_length()].append(r)
    for own in cells.values():
        want, n = [True] * len(own), len(own)
        for m, (slack, *judged) in fertility.MEASURES.items():
            v = sorted(math.floor(min(r[m], fertility.TOP) / fertility.STEP) for r in own)
            low, mid, high = (v[max(1, math.ceil(n * q)) - 1] for q in (fertility.TAIL_SHARE, 0.5, 1 - fertility.TAIL_SHARE))
            k = fertility.MARGIN + fertility.FEW / n
            for i, r in enumerate(own):
                if "low" in judged:
                    want[i] &= r[m] >= (low - k * (mid - low)) * fertility.STEP - slack
                if "high" in judged:
                    want[i] &= r[m] <= (high + 1 + k * (high - mid)) * fertility.STEP + slack or r[m] >= fertility.TOP
        for i, r in enumerate(own):
            least, most, share, bits, piece = fertility.BANDS[r["script"]]
            fixed = least <= r["chars_per_token"] <= most and r["byte_share"] <= share and r["entropy"] >= bits and r["chars_per_piece"] >= piece
            assert r["in_bands"] == (fixed and want[i])


# --- packing


def test_packing_round_trip(spark, odd):
    tokeniser = pieces.load(WORD)
    texts = [(i, t) for i, t in enumerate(fuzz(300, 3))] + [(10_000 + i, r["text"]) for i, r in enumerate(odd.collect())]
    got = rows(packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), WORD))
    pieces_of = collections.defaultdict(list)
    for r in got:
        pieces_of[r["doc_id"]].append(r)
    for i, t in texts:
        ids = np.array([*tokeniser.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces_of[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    check_sequences(got)


def test_word_forms_equal_the_library():
    """Words of letters, also with accents, share a form with or without signs behind them and in either case."""
    tokeniser = pieces.load(WORD)
    words = ["Größe", "GRÖSSE###", "größe", "größe%%%", "été.&&&", "Été", "don't", "don'", "İstanbul,", "Ǆ", "×", "a×b", "ab<|", "<|endoftext|>", "<|ENDOFTEXT|>", "x<|endoftext|>", "e\u0301té", "\u0301", "σς", "ΣΑΣ!", "555-9917", "ﬁn", "a\u00a0b", "a\u0338=", "b=\u0338", "Ⱥb!", "日本語。"]
    texts = [" ".join(words), *words, "", "\n".join(reversed(words))]
    own = packing.WordIds(WORD)
    for _ in range(2):
        ids, sizes = own.encode([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*tokeniser.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    forms = set(own.forms)
    assert "größe".encode() in forms and not forms & {"Größe".encode(), "größe%%%".encode(), "GRÖSSE###".encode()}
    assert packing.WordIds(WORD).tokeniser is own.tokeniser  # read once by a process


def check_sequences(got):
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return sum(r["length"] for r in got) / (4096 * len(by))


def test_packing_fills_and_takes_repeated_rows(docs):
    got = rows(packing.pack(docs.union(docs), WORD))
    assert check_sequences(got) > 0.95
    assert sum(r["start"] == 0 for r in got) == 2 * docs.count()


# --- language model


def test_gradients_by_difference():
    rng = np.random.default_rng(2)
    net = lm.Network([5, 4, 3, 2], [1] * lm.TAIL, seed=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(0, 4 + lm.TAIL, (4, 3)), rng.integers(0, 4 + lm.TAIL, (4, 3))

    def loss():
        s, saved = lm.gru.forward(x, np.zeros((3, lm.HIDDEN)), net.w)
        return s, saved, -net.output(s.reshape(-1, lm.HIDDEN), y.ravel())[0].mean()

    s, saved, _ = loss()
    grads = {}
    _, d = net.output(s.reshape(-1, lm.HIDDEN), y.ravel(), grads)
    grads |= lm.gru.backward(x, d.reshape(s.shape), saved, net.w)
    for k in ("W", "U", "b", "C", "c", "D", "d"):
        flat = net.w[k].reshape(-1)
        i = int(np.abs(grads[k]).argmax())
        flat[i] += 1e-5
        up = loss()[2]
        flat[i] -= 2e-5
        down = loss()[2]
        flat[i] += 1e-5
        assert math.isclose((up - down) / 2e-5, grads[k].reshape(-1)[i], rel_tol=2e-3, abs_tol=1e-7)


def test_state_is_carried_across_windows():
    net = lm.Network([5, 4, 3], [1] * lm.TAIL, seed=3)
    rng = np.random.default_rng(0)
    sizes = np.array([1, 200, 33, 32, 64])
    flat = rng.integers(0, 3 + lm.TAIL, sizes.sum())
    got, start = net.score(flat, sizes), 0
    for k, n in enumerate(sizes):
        own, h, want = flat[start : start + n], np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for t in range(n):
            h = lm.gru.step(net.w["W"][[own[t - 1] if t else 0]], h, net.w)
            want += net.output(h, own[t : t + 1])[0][0]
        assert math.isclose(got[k], want, rel_tol=1e-4)
        start += n


def test_probabilities_add_up():
    net = lm.Network([5, 4, 3, 2, 9], [1] * lm.TAIL, seed=3)
    h = np.random.default_rng(0).normal(size=(1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(5 + lm.TAIL)
    assert math.isclose(np.exp(net.output(np.repeat(h, len(every), 0), every)[0]).sum(), 1, rel_tol=1e-4)


def test_lm_base_and_model(docs, odd):
    for d in (docs, odd):
        got = lm.likelihood(d, fold("doc_id", 7) == 2, rounds=2).collect()
        source = d.select("doc_id", "text").collect()
        count = collections.Counter()
        for r in source:
            if zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 7 != 2:
                count.update([*words((r["text"] or "").encode().lower().decode()), None])
        n, v = sum(count.values()), len(count)
        want = collections.Counter()
        for r in source:
            own = [*words((r["text"] or "").encode().lower().decode()), None]
            base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
            want[(r["doc_id"], len(own), sum(count[w] > 0 for w in own), n, round(base, 4))] += 1
        assert want == collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got)
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    held = [r for r in lm.likelihood(docs, fold("doc_id", 7) == 2).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_long_texts_are_scored_in_few_products(monkeypatch):
    """A long text alone fills a window, so its steps share the products of the output layer."""
    net, calls = lm.Network([5, 4, 3], [1] * lm.TAIL, seed=3), []
    whole = net.output
    monkeypatch.setattr(net, "output", lambda h, s: calls.append(len(h)) or whole(h, s))
    sizes = np.array([10_000, 20, 3])
    flat = np.random.default_rng(0).integers(0, 3 + lm.TAIL, sizes.sum())
    got = net.score(flat, sizes)
    assert sum(calls) == sizes.sum() and len(calls) <= 2
    assert math.isclose(got[1], net.score(flat[10_000:10_020], sizes[1:2])[0], rel_tol=1e-4)


def test_logits_beyond_exp():
    net = lm.Network([5, 4, 3], [1] * lm.TAIL, seed=3)
    net.w["C"][0], net.w["c"][1] = 300, -700
    h = np.random.default_rng(0).uniform(-1, 1, (50, lm.HIDDEN)).astype(np.float32)
    every, grads = np.arange(3 + lm.TAIL), {}
    for row in h:
        assert math.isclose(np.exp(net.output(np.repeat(row[None], len(every), 0), every)[0]).sum(), 1, rel_tol=1e-3)
    out, d = net.output(h, np.arange(50) % len(every), grads)
    assert all(np.isfinite(x).all() for x in (out, d, *grads.values()))


def test_lm_symbols_of_odd_texts(spark):
    odd = ["", None, "  ", "a", " A b\x0bC\x0cd\x1c\x1d e\x85f\xa0g. ", "É! Ñ\r\n\tx,", "".join(map(chr, range(1, 300))), "　zz y", "b? b"]
    heads = {b"a": 1, b"x,": 3, b"zz": 2}
    own = [(t or "").encode().lower().split() for t in odd]
    want = [[heads.get(w, 4 + zlib.crc32(w[:2]) % lm.PAIRS * 2 + (w[-1] in lm.MARKS)) for w in t] + [0] for t in own]
    for column in (pa.array(odd), pa.array(["q q", *odd]).slice(1), pa.array(odd, pa.large_string())):
        assert [x.tolist() for x in lm.symbols(column, heads, 4)] == want
        words, sizes = lm.tokens(column)
        assert words.to_pylist() == sum(own, []) and sizes.tolist() == [len(t) for t in own]
    rows = spark.createDataFrame([(bytearray(w),) for w in words.to_pylist()], "word binary")
    sql = {bytes(r[0]): r[1] for r in rows.select("word", lm.tail_class_sql(F.col("word"))).collect()}
    assert [sql[w] for w in words.to_pylist()] == lm.tail_classes(words, np.arange(len(words))).tolist()


def test_lm_weights_are_averaged_by_tokens():
    net = lm.Network([5, 4, 3], [1] * lm.TAIL, seed=3)
    a, b = net.flat(), np.arange(len(net.flat()), dtype=np.float32)
    found = pa.table({"task": pa.array([7, 2], pa.int32()), "tokens": [30, 10], "weights": pa.array([a.tobytes(), b.tobytes()], pa.binary())})
    got = lm.averaged(found)
    assert got.column("tokens").to_pylist() == [40]
    mean = np.frombuffer(got.column("weights")[0].as_py(), np.float32)
    assert np.allclose(mean, 0.75 * a + 0.25 * b, atol=1e-3)
    net.set_flat(a)
    assert (net.flat() == a).all()


def test_lm_takes_long_texts_and_grows_with_rows(spark):
    """Whole long texts train the network; what it sees is a share of all training tokens."""
    rng = random.Random(3)
    made = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 60)))) for i in range(400)]
    made.append((1000, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30_000))))
    d = spark.createDataFrame(made, "id long, text string").withColumn("held_out", F.lit(False))
    heads = {c.encode() * 3: i + 1 for i, c in enumerate("abcdefgh")}
    all_tokens = sum(len(t.split()) + 1 for _, t in made)
    for long_only in (False, True):
        own = d.where("id = 1000") if long_only else d
        net = lm.Network([400] + [500] * 8, [0] * lm.TAIL, 1)
        seen = own.select("text").mapInArrow(lm.learner(net, heads, 4, 1.0), lm.WEIGHTS).agg(F.sum("tokens")).first()[0]
        assert seen == (30_001 if long_only else all_tokens)
    net = lm.Network([400] + [500] * 8, [0] * lm.TAIL, 9)
    start = net.flat()
    assert (lm.train(d, heads, [400] + [500] * 8, [0] * lm.TAIL, 1.0, 2, 4, 9).flat() != start).mean() > 0.1
    again = [lm.train(d, heads, [400] + [500] * 8, [0] * lm.TAIL, 1.0, 2, 4, 9).flat() for _ in range(2)]
    assert (again[0] == again[1]).all()


def test_lm_learns_more_from_a_larger_share(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    score = [lm.likelihood(docs, fold("doc_id", 7) == 2, share=s).where("held_out").agg(F.sum("score")).first()[0] for s in (0.1, 1.0)]
    assert score[0] < score[1]


def test_lm_learns_from_all_training_rows(spark):
    """Unless a share is asked for, every training row is in one of the rounds."""
    rng = random.Random(4)
    made = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 40)))) for i in range(300)]
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(2).localCheckpoint()
    held = fold("doc_id", 7) == 2
    every = {r["doc_id"]: r["score"] for r in lm.likelihood(d, held, share=1.0, rounds=2).collect()}
    assert {r["doc_id"]: r["score"] for r in lm.likelihood(d, held, rounds=2).collect()} == every


# --- sharding


def test_matrix_margins_and_law():
    parts, shards = [7, 0, 12, 5], [8, 8, 8]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = np.array(sharding.communication_matrix(parts, shards, seed))
        assert m.sum(1).tolist() == parts and m.sum(0).tolist() == shards
        total += m
    assert np.abs(total / 400 - np.outer(parts, shards) / 24).max() < 0.25


def test_hypergeometric_is_exact():
    rng = random.Random(1)
    n = 20_000
    got = collections.Counter(sharding.hypergeometric(6, 9, 5, rng) for _ in range(n))
    for k in range(6):
        want = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(got[k] / n - want) < 0.015
    assert 0 <= sharding.hypergeometric(10**9, 10**9, 50_000, rng) <= 50_000


def test_shards(odd, docs):
    for d in (odd, docs.union(docs)):
        got = rows(sharding.shard(d))
        sizes = collections.defaultdict(list)
        for r in got:
            sizes[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
        n = [len(sizes[s]) for s in range(40)]
        assert sum(n) == len(got) == d.count() and max(n) - min(n) <= 1
        want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in d.collect())
        assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    one, two = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows(sharding.shard(docs))) for _ in range(2))
    assert one == two


# --- mixing


def test_mix_properties(odd, docs):
    got = rows(mixing.mix(odd))
    assert len(got) == odd.count()
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    by = collections.defaultdict(list)
    for r in rows(mixing.mix(docs)):
        by[r["source"]].append(r)
    total = sum(r["size"] for own in by.values() for r in own)
    assert math.isclose(sum(own[0]["target"] for own in by.values()), total, rel_tol=1e-9)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_targets_by_repeated_sharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 50, "é": 700, None: 30}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    names = sorted((s for s in sizes if s), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        among, spent = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            more = min(left * weight[s] / among, 3 * sizes[s] - want[s])
            want[s] += more
            spent += more
            if want[s] >= 3 * sizes[s] - 1e-9:
                open_.discard(s)
        left -= spent
    assert all(math.isclose(got[s], want[s], rel_tol=1e-6, abs_tol=1e-5) for s in names)


# --- near duplicates


def brute(texts):
    sets, up = {}, {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, t in texts:
        w = words((t or "").encode().lower().decode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        up[i] = i
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(seed, n_groups, copies):
    """Groups of texts that are copies with a growing number of edits, with similarities on both sides of the limit."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_groups):
        base = [f"v{rng.randint(0, 4000)}" for _ in range(rng.choice([3, 5, 30, 80, 300]))]
        for k in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 9999)}"
            if k % 5 == 4:
                own += ["a passage that many texts share and that is long enough for several shingles"]
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed, monkeypatch):
    texts = edited(seed, 25, 12) + [(5000 + i, "hot line shared by all of these " + f"end{i} " * 2) for i in range(40)]
    want = brute(texts)
    monkeypatch.setattr(jaccard, "GROUP", 16 if seed == 2 else 4096)  # blocks
    got = by_id(jaccard.near_texts(spark.createDataFrame(texts, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want


def test_jaccard_repeated_rows(spark):
    """Every row twice: groups of an even number of rows are still told apart by their members."""
    texts, shingles = edited(3, 6, 8), jaccard.Shingles(5)
    for k in range(6):  # A links with C, but shares its smallest shingle with B alone
        a, b = [f"a{k}x{i}" for i in range(60)], [f"b{k}x{i}" for i in range(60)]
        at = min(range(56), key=lambda i: shingles.sets([" ".join(a[i : i + 5]).encode()])[0][0])
        b[at : at + 5] = a[at : at + 5]
        texts += [(7000 + 10 * k + i, " ".join(t)) for i, t in enumerate((a, b, [*a[: at + 2], "z", *a[at + 3 :]]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = rows(jaccard.near_texts(docs.union(docs)))
    assert len(got) == 2 * len(texts)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, *x) for i, x in brute(texts).items()}


def test_jaccard_ids_with_several_texts(spark):
    """Every text of an id links, and brings what it links with to the id; smaller ids and empty texts too."""
    texts = edited(5, 14, 8)
    ids = [i // 2 if i % 14 < 4 else 1000 + i for i, _ in texts]  # ids with two texts, of any groups
    pairs = [(i, t) for i, (_, t) in zip(ids, texts, strict=True)]
    extra = next(i for i in ids if i < 1000)
    pairs += [(5, ""), (extra, None), (3000, ""), (3001, pairs[-1][1]), (3001, " ")]
    own = brute(list(enumerate(t for _, t in pairs)))
    up = {i: i for i, _ in pairs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, _) in enumerate(pairs):
        a, b = find(i), find(pairs[own[k][1]][0])
        up[max(a, b)] = min(a, b)
    want = collections.Counter((i, own[k][0], find(i)) for k, (i, _) in enumerate(pairs))
    got = rows(jaccard.near_texts(spark.createDataFrame(pairs, "doc_id long, text string")))
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_jaccard_odd_rows(odd):
    got = rows(jaccard.near_texts(odd))
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[11]["component_id"] == 10
    assert [by[i]["n_shingles"] for i in (3, 4, 5, 9)] == [0, 0, 0, 1] and by[None]["component_id"] is None


def test_bitmaps_are_at_most_a_byte_a_shingle():
    texts = [" ".join(f"w{i}" for i in range(n + 4)) for n in (70, 100, 128, 500)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(4), pa.int64()), "text": texts})
    [got] = jaccard.signatures(5, 75, np.zeros(0, np.uint64))([batch])
    for n, bits in zip(got.column("n").to_pylist(), got.column("bits").to_pylist(), strict=True):
        assert n / 2 <= len(bits) <= n


def test_trees_lose_no_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 62, rng.integers(20, 120)).astype(np.uint64)
        for _ in range(6):
            s = base.copy()
            s[rng.random(len(s)) < rng.random() * 0.3] = rng.integers(0, 1 << 62)
            sets.append(np.unique(s))
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    bits = np.zeros((len(sets), 256), bool)
    for i, s in enumerate(sets):
        bits[i, (s & np.uint64(255)).astype(int)] = True
    bits = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.Tree(np.arange(len(sets)), sizes, bits)
    found = set()
    for i, j in jaccard.traverse(tree, tree, 75):
        x, y = tree.leaf(i), tree.leaf(j)
        ok = jaccard.possible(bits[x], sizes[x], bits[y], sizes[y], 75)
        found |= {tuple(sorted((x.start + p, y.start + q))) for p, q in np.argwhere(ok > 0).tolist()}
    n_links = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                n_links += 1
                assert (j, i) in found
    assert n_links > 20 and len(list(jaccard.traverse(tree, tree, 75))) < len(tree.levels[0][1]) ** 2 / 2


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    odd.withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (7, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert name == "packing" or docs.columns == columns
    assert docs.count() > 0
