import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sonolith.llm import langid, licenses, packing, queries, sharding, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, length string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, s, "x", "y") for i, t, la, s in rows], SCHEMA)


def real_tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(packing.tokenizer_path())
    found.encode_special_tokens = True
    return found


ODD = [None, "", " ", "\n\n  a", "é😀ß 12.5 it's don't", "x" * 5000, "<|endoftext|> a", "a b c\x00d", "ab " * 4000, "日本語のテキスト", "   \t  x  "]


def test_packing_round_trip(spark, small):
    texts = ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "again", None, None), (3, ODD[3], None, None)]
    got = packing.pack(frame(spark, rows)).collect()
    tokenizer = real_tokenizer()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and 1 << r.bucket == r.length
    assert len({r.sequence_id for r in got}) == len(got)
    for i, t, *_ in rows[:-1]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r.start)
        own = own[::2] if i == 3 else own  # the repeated row
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert {r.doc_tokens for r in own} == {len(ids)}
    assert packing.pack(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), context=1000)


def test_packing_query(spark, small):
    pieces = packing.pack(spark.read.parquet(f"{small}/documents.parquet")).collect()
    want = {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in pieces}
    assert {(r.doc_id, r.start): r.ids_crc32 for r in queries.op3_packing(spark, small).collect()} == want


def test_packing_added_tokens(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    end = "<|endoftext|>"
    texts = [*ODD, f"a {end} b", end, f"  {end}  \n{end}{end} x", f"a {end[:-1]} b", f"é  {end.upper()} {end}s 12"]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for i, t in enumerate(texts):
        ids, start = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], 0
        for n in packing.piece_lengths(len(ids)):
            want[i, start] = (n, len(ids), zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))
            start += n
    got = queries.op3_packing(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.start): (r.length, r.doc_tokens, r.ids_crc32) for r in got} == want
    got = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert {(r.doc_id, r.start): (r.length, r.doc_tokens, zlib.crc32(bytes(r.ids))) for r in got} == want


def brute_count(word, scores):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for j in range(1, len(word) + 1):
        size = len(word[j - 1].encode())
        best[j] = (best[j - 1][0] + size * tokencount.BYTE_SCORE, best[j - 1][1] - size)
        for i in range(max(0, j - 64), j):  # no piece has more characters
            if (s := scores.get(word[i:j])) is not None:
                best[j] = max(best[j], (best[i][0] + s, best[i][1] - 1))
    return -best[-1][1]


def test_token_counts_equal_brute_force(spark, small):
    texts = ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    got = {r.doc_id: r for r in tokencount.token_counts(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    scores = tokencount.pieces(tokencount.vocabulary_path())
    assert max(map(len, scores)) <= 64
    cache: dict[str, int] = {}
    for i, t in enumerate(texts):
        words = Counter(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        for w in words:
            if w not in cache:
                cache[w] = brute_count("▁" + w, scores)
        assert got[i].n_words == words.total()
        assert got[i].n_tokens == sum(cache[w] * n for w, n in words.items())
    for bounds in ({"limit": 50}, {"most_bytes": 500}, {"limit": 3000, "most_bytes": 20_000}):
        trie = tokencount.Trie(scores, **bounds)
        assert all(trie.count(w) == n for w, n in cache.items())


def test_token_counts_of_odd_rows(spark):
    rows = [(None, "a word", None, None), (1, "a word", None, None), (1, "a word", None, None), (2, None, None, None)]
    got = [(r.doc_id, r.n_words, r.n_tokens) for r in tokencount.token_counts(frame(spark, rows)).collect()]
    assert got[0][1:] == got[1][1:] == got[2][1:] and got[0][1] == 2 and got[3] == (2, 0, 0)
    assert tokencount.token_counts(frame(spark, [])).collect() == []


def test_trie_of_long_words_is_bounded():
    scores = tokencount.pieces(tokencount.vocabulary_path())
    trie, rng = tokencount.Trie(scores, limit=50, most_bytes=10_000), random.Random(1)
    for _ in range(300):
        word = "".join(rng.choices("abcdefgh", k=rng.randint(600, 900)))
        assert trie.count(word) == brute_count("▁" + word, scores)
        assert len(trie.score) <= 50 and sum(map(len, trie.terminal)) < 11_000
    word = "".join(rng.choices("abcdeß世", k=140_000))
    assert trie.count(word) == brute_count("▁" + word, scores)


def test_language_id(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9


def test_language_id_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", None), (2, "der Hund und die Katze", "de", None), (None, "und der", "de", None), (4, "the", None, None)]
    model = langid.fit(frame(spark, rows))
    assert model.languages == ["de", "en"]
    ask = [(1, None, None, None), (2, "", None, None), (3, "12 34! ½ ²", None, None), (None, "the dogs", None, None), (5, "Katzen und Hunde " * 5000, None, None)]
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(frame(spark, ask), model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "de")]
    none = langid.fit(frame(spark, []))
    assert [r.lang_pred for r in langid.predict(frame(spark, ask), none).collect()] == ["und"] * 5
    assert langid.predict(frame(spark, []), model).collect() == []


def plain_backoff(rows):
    """A predictor by the plain rule: dictionaries of counts for each language, one word at a time."""
    words = lambda text: [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(c.isalpha() for c in w)]
    cut = lambda w, n: [w] if n == 0 else list(w) if n == 1 else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    langs = sorted({lang for _, text, lang, _ in rows if lang is not None and text is not None})
    counts = [{lang: Counter() for lang in langs} for _ in range(5)]
    for _, text, lang, _ in rows:
        if lang is not None and text is not None:
            for w in words(text):
                for n in range(5):
                    counts[n][lang].update(cut(w, n))
    known = [set().union(*c.values()) for c in counts]

    def score(n, gram, lang):
        c = counts[n][lang]
        return math.log((c[gram] + 0.5) / (max(1, sum(c.values())) + max(1, len(known[n]))))

    def predict(text):
        found = words(text)
        if not found or not langs:
            return "und", 0.0
        total = dict.fromkeys(langs, 0.0)
        for w in found:
            for n in (0, 4, 3, 2, 1):
                if seen := [g for g in cut(w, n) if g in known[n]]:
                    for lang in langs:
                        total[lang] += sum(score(n, g, lang) for g in seen) / len(seen) / len(found)
                    break
        ranked = sorted(langs, key=lambda x: (-total[x], x))
        return ranked[0], 1.0 if len(langs) == 1 else 1 / (1 + math.exp(total[ranked[1]] - total[ranked[0]]))

    return predict


def test_language_id_equals_the_plain_rule(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéñ"
    vocabulary = {f"l{k:03}": ["".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(30)] for k in range(120)}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=40)), lang, None) for i, lang in enumerate([*vocabulary] * 3)]
    rows += [(900, None, "l000", None), (901, "word", None, None), rows[0]]
    model = langid.fit(frame(spark, rows))
    assert len(model.languages) == 120
    plain = plain_backoff(rows)
    ask = [t for _, t, _, _ in rows[:40]] + [" ".join("".join(rng.choices(letters, k=6)) for _ in range(n)) for n in range(1, 60)] + ["", None, "½ 12", "\u4e16\u754c"]
    got = langid.predict(frame(spark, [(i, t, None, None) for i, t in enumerate(ask)]), model).collect()
    for r in got:
        lang, score = plain(ask[r.doc_id])
        assert math.isclose(r.score, score, abs_tol=1e-5)
        assert r.lang_pred == lang or score < 0.5 + 1e-5
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in got[:40]) == 40


def test_language_id_keeps_every_word_of_its_sample(spark):
    rows = [(i, " ".join("abcdefghij"[int(c)] for c in str(i)) + f" w{'x' * (i % 40)}", "ab"[i % 2], None) for i in range(400)]
    some = langid.fit(frame(spark, rows), sample=50)
    every = langid.fit(frame(spark, rows))
    assert some.languages == every.languages == ["a", "b"] and len(some.keys) <= len(every.keys)
    few = langid.fit(frame(spark, [(i, "word " * 100, "a", None) for i in range(400)]), characters=5000)
    assert 0 < math.exp(few.gain.max()) / 2 < 2500  # about ten documents of a hundred words


def plain_shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_licenses(spark, small):
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor "
    rows = [(1, None, None, None), (2, "", None, None), (3, filler * 20, None, None), (4, "under the MIT", None, None)]
    for n, (_name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        rows.append((10 + n, filler * (n % 4) + text.upper() + " " + filler * 9, None, None))
        words = text.split()
        if len(words) > 60:
            words[len(words) // 2] = "changed"
            rows.append((50 + n, filler + " ".join(words) + " " + filler, None, None))
    rows.append((None, licenses.TEMPLATES["MIT"], None, None))
    got = licenses.find_licenses(frame(spark, rows)).collect()
    want = set()
    for i, t, *_ in rows:
        own = plain_shingles(t)
        for name, text in licenses.TEMPLATES.items():
            need = plain_shingles(text)
            if need and len(need & own) >= 0.75 * len(need):
                want.add((i, name, len(need & own)))
    assert {(r.doc_id, r.license, r.n_shared) for r in got} == want
    assert licenses.find_licenses(frame(spark, [])).collect() == []
    assert licenses.find_licenses(frame(spark, rows), templates={}).collect() == []
    found = {(r.doc_id, r.license) for r in queries.op8_license_scan(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    need = {n: plain_shingles(t) for n, t in licenses.TEMPLATES.items()}
    assert found == {(r.doc_id, n) for r in docs for n, s in need.items() if len(s & plain_shingles(r.text)) >= 0.75 * len(s)}


def test_license_bank_of_any_size(spark):
    rng, vocabulary = random.Random(3), [f"w{i}" for i in range(400)]
    bank = {f"t{k:04}": " ".join(rng.choices(vocabulary, k=rng.randint(5, 30))) for k in range(1000)}
    rows = [(i, "before " + bank[f"t{i * 37 % 1000:04}"] + " after", None, None) for i in range(40)]
    rows += [rows[0], (41, None, None, None), (42, "", None, None)]
    want = Counter()
    for i, text, _, _ in rows:
        have = plain_shingles(text)
        for name, template in bank.items():
            own = plain_shingles(template)
            if len(own & have) >= 0.75 * len(own):
                want[i, name, len(own & have)] += 1
    for bounds in ({}, {"most_templates": 300, "most_words": 4000}):
        got = licenses.find_licenses(frame(spark, rows), templates=bank, **bounds).collect()
        assert Counter((r.doc_id, r.license, r.n_shared) for r in got) == want
    assert licenses.find_licenses(frame(spark, rows), templates={}).collect() == []
    assert licenses.find_licenses(frame(spark, [])).collect() == []


def test_license_bands_retrieve_similar_windows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(2000):
        a = rng.integers(-(1 << 63), (1 << 63) - 1, 10).tolist()
        rows.append((a[:8], a[2:]))  # 6 shared of 10: a similarity of 0.6
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    met = F.arrays_overlap(licenses._bands(F.col("a"), 8, 8), licenses._bands(F.col("b"), 8, 8))
    share = df.agg(F.avg(met.cast("double"))).first()[0]
    assert share > 0.96, share


def test_license_one_word_edits(spark):
    rows, want = [], set()
    for name, text in sorted(licenses.TEMPLATES.items()):
        words = text.split()
        for i in range(len(words)):
            for edited in ([*words[:i], f"new{i}", *words[i:]], [*words[:i], f"new{i}", *words[i + 1 :]], [*words[:i], *words[i + 1 :]]):
                rows.append((len(rows), "lorem " * (i % 9) + " ".join(edited) + " ipsum dolor", None, None))
    for i, t, *_ in rows:
        own = plain_shingles(t)
        want |= {(i, n) for n, x in licenses.TEMPLATES.items() if (need := plain_shingles(x)) and len(need & own) >= 0.75 * len(need)}
    got = {(r.doc_id, r.license) for r in licenses.find_licenses(frame(spark, rows)).collect()}
    assert got == want, (len(want), want - got)


def test_sharding(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, None, None) for r in docs] + [(None, None, None, None), (1, "z" * 30_000, None, None)]
    rows += [(9, "same", None, None)] * 3 + [(9, "x" * i, None, None) for i in range(3000, 3040)]
    for limit in (1, 20_000, 1 << 30):
        sharded = sharding.shards(frame(spark, rows), limit=limit).collect()
        assert len(sharded) == len(rows) and sum(r.n_bytes for r in sharded) == sum(len((t or "").encode()) for _, t, *_ in rows)
        by: dict[str, list] = {}
        for r in sharded:
            assert len(r.shard) == r.depth
            by.setdefault(r.shard, []).append(r)
        for shard, own in by.items():
            total = sum(r.n_bytes for r in own)
            assert {r.fits for r in own} == {total <= limit}
            assert total <= limit or len(own) == 1 or len(shard) == sharding.WIDTH
            # A directory: no shard's prefix is another's, and a split was needed.
            assert not any(shard != s and s.startswith(shard) for s in by)
            if shard:
                parent = [r for s, x in by.items() if s.startswith(shard[:-1]) for r in x]
                assert sum(r.n_bytes for r in parent) > limit
    assert sharding.shards(frame(spark, [])).collect() == []
    assert sharding.directory(sharding.shards(frame(spark, rows))).agg(F.sum("n_docs")).first()[0] == len(rows)
