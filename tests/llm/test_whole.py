"""Cases that once got less than the whole job."""

import random

import numpy as np
import pyarrow as pa
from test_operators import brute_components, crc, shingles
from tokenizers import Tokenizer

from weftlog.llm import near, packing, secrets, tokenfiles, tokens


def copies(spark, groups, rng):
    """Groups of near copies: word texts in which a few words are replaced."""
    texts = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(60)]
        for k in range(int(rng.integers(2, 6))):
            words = list(base)
            for j in rng.choice(60, int(rng.integers(0, 2)), replace=False):
                words[j] = f"x{g}_{k}_{j}"
            texts.append(" ".join(words))
    rows = {k: {"text": t} for k, t in enumerate(texts)}
    return rows, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def test_salted_lists_lose_no_link(spark, monkeypatch):
    rows, df = copies(spark, 40, np.random.default_rng(7))
    want = brute_components(rows)
    for long, counters, bits in ((1, 1 << 18, 1 << 20), (10, 1 << 18, 1 << 10), (1, 16, 1 << 20)):
        monkeypatch.setattr(near, "LONG_LIST", long)
        monkeypatch.setattr(near, "COUNTERS", counters)
        monkeypatch.setattr(near, "FILTER_BITS", (bits, bits))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.near_duplicates(df).collect()}
        assert got == want


def test_every_link_is_counted(spark, monkeypatch):
    rows, df = copies(spark, 12, np.random.default_rng(11))
    texts = [" ".join(f"s{j}" if j not in (k, k + 1) else f"own{k}_{j}" for j in range(100)) for k in range(0, 90, 2)]
    rows |= {1000 + k: {"text": t} for k, t in enumerate(texts + texts[:3])} | {2000: {"text": None}, 2001: {"text": "alone"}}
    df = df.unionByName(spark.createDataFrame([(d, r["text"]) for d, r in rows.items() if d >= 1000], df.schema)).repartition(5)
    sets = {d: shingles(r["text"]) for d, r in rows.items()}
    want = {d: sum(e != d and 100 * len(a & b) >= 80 * len(a | b) > 0 for e, b in sets.items()) for d, a in sets.items()}
    assert max(want.values()) > 40
    for docs, grams in ((near.BLOCK_SETS, near.BLOCK_GRAMS), (7, 1000)):
        monkeypatch.setattr(near, "BLOCK_SETS", docs)
        monkeypatch.setattr(near, "BLOCK_GRAMS", grams)
        got = {r["doc_id"]: r["n_links"] for r in near.near_duplicates(df).collect()}
        assert got == want


def test_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 4)
    rows = [(k, f"some words {k} " * (5 + k % 40), None if k % 9 == 8 else f"h{min(k % 9, k % 7)}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for weights in (None, {"h1": 0.5, "h5": 0.3, "h6": 0.2}):
        at, sequences = {}, {}
        for p in sorted(packing.pack(df, length=512, weights=weights).collect(), key=lambda p: (p["doc_id"], p["start"])):
            assert p["start"] == at.get(p["doc_id"], 0) and p["queue"] == rows[p["doc_id"]][2]
            at[p["doc_id"]] = p["start"] + p["length"]
            sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
            if at[p["doc_id"]] == p["doc_tokens"]:
                at[p["doc_id"]] = "whole"
        assert at == {k: "whole" for k in range(200)}
        used = []
        for s in sorted(sequences):
            end = 0
            for offset, n in sorted(sequences[s]):
                assert offset == end
                end += n
            used.append(end)
        assert sorted(sequences) == list(range(len(sequences)))
        assert all(u == 512 or u < 512 and u & (u - 1) == 0 for u in used) and sum(u == 512 for u in used) > 5


def test_added_tokens_keep_their_ids(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|startoftext|>y", "A <|ENDOFTEXT|> b", "plain text", None, ""]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    for name, blank, end in (("word_bpe_49k.json", False, 2), ("byte_bpe_50k.json", True, 0)):
        model = Tokenizer.from_file(tokens.vocabulary(name))
        ids = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert (50256 if blank else 49407) in ids[0]
        flat, ends = tokens.encoder(name, blank).encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(flat, ends[:-1])] == ids
        if blank:
            got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.round_trip(df).collect()}
            assert got == {k: (len(x) + 1, crc([*x, end])) for k, x in enumerate(ids)}
        else:
            assert {r["doc_id"]: r["doc_tokens"] for r in packing.pack(df).collect()} == {k: len(x) + 1 for k, x in enumerate(ids)}


def test_the_field_tags_secrets_without_digits(spark):
    rng = np.random.default_rng(5)
    name = lambda: "".join(rng.choice(["Horse", "Battery", "Staple", "Alpha", "Hunter", "Key", "Blue"], 3))
    plain = "the quick brown fox jumps over a lazy dog and they said: it is fine".split()
    texts = [f"{' '.join(rng.permutation(plain))} {rng.choice(['token', 'secret', 'password'])}: {name()} {' '.join(rng.permutation(plain))}" for _ in range(300)]
    said = "some quiet words without any sign stand here before credential: CorrectHorseBattery and others follow after it"
    texts.append(said)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digests(df).collect()}
    at = said.index("CorrectHorseBattery")
    assert got[300]["spans"].split(",") == [f"crf:{at}:{at + 19}"]
    assert all(got[k]["n_assign"] == 1 for k in range(300))


def test_cut_texts_have_the_ids_of_whole_texts(monkeypatch):
    rng = random.Random(1)
    letters = list("abcsStTrReElLvVm'''  \n\t12.,!?éÉàĀœ×÷İ<|>-")
    texts = [
        "It's we'll they've I'M ''s 's ,'s x's's 'stop 're'll", "  two  blanks ", "\n\n a\n b\t\tc \r\n", "12 345 a1b2", "naïve Œuvre Ÿ Ā Ɏ ɏ Ɓɓ", "İ i̇!", "a × b ÷ c",
        "a <|endoftext|> b <|startoftext|>", "€€ 123", "日本 x", "'", "a 's b", "a\n's b", "x\x0by\x0cz", " 'll", "donʼt don'T", "ǅ ǈ ẞ ß", "x" * 2000, "", None,
    ]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(letters) for _ in range(4000)) for _ in range(8)]
    for name, blank in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        want = [x.ids for x in Tokenizer.from_file(tokens.vocabulary(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for run, remembered in ((tokens.RUN, tokens.REMEMBERED), (700, 500)):
            monkeypatch.setattr(tokens, "RUN", run)
            monkeypatch.setattr(tokens, "REMEMBERED", remembered)
            flat, ends = tokens.Encoder(name, blank).encode(pa.array(texts))
            assert [x.tolist() for x in np.split(flat, ends[:-1])] == want


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "_BYTE", np.ones(256, np.uint64))
    texts = ["some words of equal size have one hash now", "and so do these", "a b c"]
    for name, blank in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        model = Tokenizer.from_file(tokens.vocabulary(name))
        flat, ends = tokens.Encoder(name, blank).encode(pa.array(texts))
        assert [x.tolist() for x in np.split(flat, ends[:-1])] == [model.encode(t, add_special_tokens=False).ids for t in texts]
