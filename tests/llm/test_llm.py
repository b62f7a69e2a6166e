"""Corpus operators on small tables with every awkward case, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowdelta.llm import arrow, automaton, bpe, cache, components, exact_dedup, packing, pii, scratch, secret_scan, shingle_join, simhash, substring_dedup, token_counts, tokens, toxicity, vector_dedup

WORDS = "the of river stone blue window under paper small garden light seven table north quiet idea music water green letter".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


def corpus():
    rng = random.Random(4)
    long = words(rng, 9000)
    base = [words(rng, 300) for _ in range(12)]
    texts = [None, "", " ", "one", "two words", long, long + " end", "a" * 3000, "naïve Ünïcode 中文 — ok\r\n\tx", *base, *base[:4]]
    near = [b.split() for b in base[:6]]
    for i, n in enumerate(near):
        n[7 + i] = "changed"
    texts += [" ".join(n) for n in near] + ["same", "same", "same  \n", " same"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("doc", "fp", "digest", "score", "m", "start"))).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def pairs(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(200 + i, 201 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(pairs(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_fingerprints_and_components(spark, docs, empty):
    import xxhash

    def fp(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    rows = corpus()
    fps = [fp(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    want = sorted((str(d), f, str(least[r])) for (d, _), f, r in zip(rows, fps, root))
    got = sorted((str(d), f % 2**64, str(c)) for d, f, c in pairs(simhash.near_duplicates(docs), "doc_id", "fp", "component"))
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_anchors_cover_every_pair_within_three_bits():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64) * 2 + rng.integers(0, 2, 2000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    met = np.zeros(len(x), bool)
    for half in (0, 1):
        part = lambda v: (v >> np.uint64(32 * half)) & np.uint64(2**32 - 1)  # noqa: B023, E731
        home, _ = simhash.anchors(part(x))
        own, more = simhash.anchors(part(y))
        met |= (own == home) | (more == home[:, None]).any(1)
    assert met.all()


def five_words(df, **how):
    return shingle_join.labelled(simhash.source_of(df, "doc_id", "text"), **simhash.FIVE_WORDS, **how).withColumnRenamed("doc", "doc_id")


def test_simhash_five_words_finds_near_copies_and_leaves_others(spark, docs):
    got = dict(pairs(five_words(docs.where("doc_id IS NOT NULL AND doc_id <> 3")), "doc_id", "component"))
    first = 9
    for i in range(6):
        assert got[first + 16 + i] == got[first + i] == first + i
    assert len({got[first + i] for i in range(12)}) == 12
    kept = simhash.survivors(docs, **simhash.FIVE_WORDS)
    assert kept.columns == docs.columns and kept.count() < docs.count()


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_simhash_five_words_drops_nothing_below_the_limit(spark):
    rng = random.Random(7)
    texts = []
    for i in range(60):
        a = words(rng, 150).split()
        b = list(a)
        for p in range(6):
            b[20 * p + 10] = f"other{p}"  # Jaccard of about 0.66
        texts += [" ".join(a), " ".join(b)]
    assert all(jaccard(texts[i], texts[i + 1]) < 0.8 for i in range(0, 120, 2))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.survivors(df, **simhash.FIVE_WORDS).count() == 120


def test_simhash_five_words_finds_every_pair_at_any_length(spark):
    rng = random.Random(8)
    texts = []
    for n in (8, 12, 50, 60, 90, 140, 200, 1500):
        for i in range(30):
            a = words(rng, n).split()
            if i % 2:  # a block at the end
                b = a + words(rng, rng.randrange(1, max(2, n // 5))).split()
            else:  # words changed
                b = [w if rng.random() > 0.03 else "other" for w in a]
            texts += [" ".join(a), " ".join(b)]
    near = [i for i in range(0, len(texts), 2) if jaccard(texts[i], texts[i + 1]) >= 0.8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for how in ({}, {"limit": 3, "members": 2}):  # in one cell, and in cells of two blocks
        got = dict(pairs(five_words(df, **how), "doc_id", "component"))
        assert len(near) > 100 and all(got[i] == got[i + 1] == i for i in near)
        assert len(set(got.values())) == len(texts) - len(near)


def test_exact_dedup(spark, docs, empty):
    rows = corpus()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    got = pairs(exact_dedup.deduplicate(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert len(got) == len(rows) and sum(k for *_, k, _ in got) == len(groups)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): (min((d for d in v if d is not None), default=None), len(v)) for k, v in groups.items()}
    assert all(by_sha[sha] == (keep, n) for _, keep, n, _, sha in got)
    assert all(not k or d == keep for d, keep, _, k, _ in got)
    assert exact_dedup.deduplicate(empty).count() == 0
    left = exact_dedup.survivors(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup_when_a_later_reading_numbers_rows_otherwise(spark, tmp_path, monkeypatch, collide):
    path, rows = str(tmp_path / "docs"), [(i, f"text {i % 7}") for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    real, sha2 = exact_dedup.scratch.written, F.sha2
    layout = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}

    def written(df, tag, *more):
        out = real(df, tag, *more)
        if tag == "keys":  # all files in one partition from here on
            for k, v in layout.items():
                spark.conf.set(k, v)
        return out

    monkeypatch.setattr(exact_dedup.scratch, "written", written)
    if collide:
        monkeypatch.setattr(F, "sha2", lambda c, n: sha2(F.length(c).cast("string") if n == 256 else c, n))
    try:
        got = pairs(exact_dedup.deduplicate(spark.read.parquet(path)), "doc_id", "keep_id", "group_size", "kept")
    finally:
        for k in layout:
            spark.conf.unset(k)
    assert sorted(got) == [(i, i % 7, 6 if i % 7 < 5 else 5, i < 7) for i in range(40)]


def test_exact_dedup_state_goes_on_over_batches(spark, tmp_path):
    keys = spark.createDataFrame([(b"a", 5, 0), (b"b", 2, 1)], "digest binary, doc long, locator long")
    for batch in (keys, spark.createDataFrame([(b"a", 1, 2)], keys.schema)):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        exact_dedup.first_seen(spark.readStream.schema(keys.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    schema = keys.groupBy("digest").agg(F.expr(exact_dedup._FIRST), F.count("*").alias("n")).schema
    got = {bytes(r.digest): (r["first"].doc, r.n) for r in exact_dedup.seen(spark, str(tmp_path / "out"), schema).collect()}
    assert got == {b"a": (1, 2), b"b": (2, 1)}


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    want = {}
    for d, t in corpus():
        want.setdefault(d, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got) == sum(len(x) for xs in want.values() for x in xs)
    for r in got:
        assert any(x[r.start : r.start + r.length].tobytes() == bytes(r.ids) and len(x) == r.doc_tokens for x in want[r.doc_id])
    for d, xs in want.items():
        cover = sorted((r.start, r.length) for r in got if r.doc_id == d)
        if len(xs) == 1:
            assert [a + n for a, n in cover[:-1]] == [a for a, _ in cover[1:]] and sum(n for _, n in cover) == len(xs[0])
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padded = 0
    for places in by_sequence.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        total = sum(n for _, n in places)
        assert total <= 4096
        padded += 0 if total & (total - 1) == 0 else 4096 - total
    assert padded < 0.02 * sum(r.length for r in got)
    assert packing.pack(empty).count() == 0
    assert all(sum(packing.cuts(n)) == n and max(packing.cuts(n)) <= 4096 for n in range(1, 9000, 7))


def test_token_counts_and_cache(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    cache = str(tmp_path / "cache")
    want = sorted((str(d), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in corpus())
    for _ in range(2):  # the second time, all from the cache
        got = sorted((str(d), b, n) for d, b, n in pairs(token_counts.count_tokens(docs, cache), "doc_id", "n_bytes", "n_tokens"))
        assert got == want
    assert spark.read.parquet(cache).count() == len({" ".join((t or "").split()) for _, t in corpus()})
    assert token_counts.count_tokens(empty, str(tmp_path / "c2")).count() == 0
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json"):
        path = tokens.vocabulary(name)
        got = dict(pairs(token_counts.count_tokens(docs.where("doc_id > 8"), str(tmp_path / name), path), "doc_id", "n_tokens"))
        if name.endswith("json"):
            other = Tokenizer.from_file(path)
            assert all(got[d] == len(other.encode(t, add_special_tokens=False).ids) for d, t in corpus() if d is not None and d > 8)


def test_special_strings_and_odd_pieces_match_the_library():
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(tokens.vocabulary()), random.Random(2)
    atoms = ["a", "Zq", "'ll", "'s", "é", "é", " ", "\n", "\x0b", "\x1c", " ", " ", "7", "42", ",", "!?", "中", "<|endoftext|>", "<|", "İ", "ß", "Σ", "ς", "_", "-", "#"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(25))) for _ in range(3000)]
    got = tokens.PieceEncoder(tokens.vocabulary(), most=500).packed([t.encode() for t in texts])
    assert all(np.frombuffer(g, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts))


def test_byte_bpe(spark, docs, empty):
    import public_tokenizers
    import tiktoken

    coder = bpe.Encoder(bpe.ranks_file(), public_tokenizers.PATTERN, most=50)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks.rank, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \n\t,.'sé中0190-_ Ω") for _ in range(rng.randrange(50))) for _ in range(1500)] + ["a" * 3000, "ab" * 900, "\0 x", "x  y", " ", ""]
    got = coder.packed([t.encode() for t in texts])
    assert all(np.frombuffer(g, "<u4").tolist() == library.encode_ordinary(t) for g, t in zip(got, texts))
    assert all(coder.ranks.decode(g).decode() == t for g, t in zip(got, texts))
    assert all(coder.ranks.encode(t) == np.frombuffer(coder.ranks.packed([t])[t], "<u4").tolist() for t in (b"unbelievable", b"zzzzqqqq", b"ab"))
    rows = sorted((str(d), zlib.crc32(i), bytes(x).decode()) for d, i, x in pairs(bpe.encode(docs), "doc_id", "ids", "decoded"))
    assert rows == sorted((str(d), zlib.crc32(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()), t or "") for d, t in corpus())
    assert bpe.encode(empty).count() == 0


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", *m.span())] * (len(m[2]) >= 12)
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda h: (h[1], secret_scan.BASE.index(h[0])))


def test_secret_scan(spark, docs, empty):
    rng = random.Random(5)
    atoms = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "0123456789abcdef", "AKIA", "AKIAABCD1234", "ABCDEFGHIJ", "deadbeef", "-", ".", "é", "\n", "xyzxyzxyzxyz", "passpassword", "ghp_"]
    for _ in range(5000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 14)))
        assert [h for h in secret_scan.find(text.encode()) if h[0] in secret_scan.BASE] == brute_secrets(text)
    assert secret_scan.find(b"-----BEGIN RSA PRIVATE KEY-----") == [("pem", 0, 31)]
    assert secret_scan.scan(docs).count() == docs.count() and secret_scan.scan(empty).count() == 0
    with pytest.raises(ValueError):
        automaton.Automaton([("bad", "ab(cde)?")])
    with pytest.raises(ValueError):
        automaton.Automaton([("nothing", "a*")])
    a = automaton.Automaton([("x", "a+b"), ("y", "(?i:q)[0-9]{2,3}")])
    assert a.scan(b"aab q12 Q1234 aaab") == [("x", 0, 3), ("y", 4, 7), ("y", 8, 12), ("x", 14, 18)]


def test_toxicity(spark, empty):
    rng, rows, marks = random.Random(6), [], []
    for i in range(900):
        bad = i % 6 == 0
        text = words(rng, 60).split()
        if bad:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["idiot", "moron"]) if i % 12 else "grob" + rng.choice(["ian", "heit", "el", "ung", "isch"])
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    out = toxicity.scored(df.withColumn("score", F.lit("x")), model).join(labels, "doc_id").withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    test = [r for r in out if r.held]
    assert 100 < len(test) < 260 and sum((r.score >= 0.5) == bool(r.toxic) for r in test) >= 0.97 * len(test)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert max(model.accuracy.values()) > 0.9
    none = toxicity.fit(df, labels.limit(0))
    assert none.score("you idiot") == none.score("") == pytest.approx(1 / (1 + np.exp(2)))
    few = toxicity.fit(df, labels.where("doc_id < 60"))
    assert few.rows < 60 and few.score("you idiot moron") > 0.5 > few.score("a small garden")
    odd = toxicity.scored(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"), model)
    assert odd.count() == 2 and toxicity.scored(empty, model).count() == 0


def test_substring_dedup(spark, docs, empty):
    rng = random.Random(8)
    passage, line = words(rng, 60), words(rng, 45)
    rows = [(i, f"{words(rng, 80)} {passage if i in (2, 5, 9) else ''} {words(rng, 40)}") for i in range(12)]
    odd = [(20, None), (21, ""), (None, f"{words(rng, 30)} {passage}"), (2, f"{words(rng, 90)} {passage}"), (30, f"{line} {line} {line} {words(rng, 50)}"), (31, "ü" * 700)]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string").withColumn("row", F.lit("x"))
    got = pairs(substring_dedup.repeated_passages(df), "doc_id", "start", "end", "first_id")
    assert sorted(str(d) for d, *_ in got if d != 31) == ["2", "30", "5", "9", "None"]
    assert all(f in (2, 5) for d, _, _, f in got if d in (5, 9, 2, None)) and {f for d, _, _, f in got if d == 30} == {30}
    for d, a, b, _ in got:
        if d in (5, 9):
            assert rows[d][1].encode()[a:b].decode(errors="ignore") in rows[2][1]
    out = substring_dedup.without_passages(df)
    assert out.columns == df.columns and {r.row for r in out.collect()} == {"x"}
    left = sorted((str(d), t) for d, t in pairs(out, "doc_id", "text"))
    assert ("2", rows[2][1]) in left or ("2", odd[3][1]) in left  # one of the two keeps the passage
    assert sum(passage in (t or "") for _, t in left) == 1 and ("20", None) in left and all(set(t) == {"ü"} for d, t in left if d == "31")
    assert len(next(t for d, t in left if d == "30")) < len(odd[4][1]) - len(line)
    assert substring_dedup.repeated_passages(empty).count() == 0 and substring_dedup.repeated_passages(docs).count() > 0
    # an insertion moves cut points only near itself
    text = words(rng, 2000).encode()

    def cut(t):
        ends = substring_dedup.segmented([t])[0]
        return [t[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    assert len(set(cut(text)) - set(cut(text[:500] + b"inserted " + text[500:]))) < 8
    assert b"".join(cut(text)) == text


def test_substring_dedup_against_brute_force(spark):
    """Chunks by a plain loop; the kept copy of each is the first in order of id and place."""
    rng = random.Random(12)
    parts = [words(rng, n) for n in (40, 55, 70, 20, 90)]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.5 else words(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    first, want, of, count = {}, [], [], Counter()
    for i, t in enumerate(texts):
        data, ends = t.encode(), substring_dedup.segmented([t.encode()])[0]
        cuts = [0, *ends]
        spans = [(cuts[k], cuts[min(k + substring_dedup.SPAN, len(ends))]) for k in range(max(1, len(ends) - substring_dedup.SPAN + 1))]
        of.append((data, spans))
        for k, (a, b) in enumerate(spans):
            first.setdefault(data[a:b], (i, k))
            count[data[a:b]] += 1
    for i, (data, spans) in enumerate(of):
        keeps = [first[data[a:b]] == (i, k) for k, (a, b) in enumerate(spans)]
        k = 0
        while k < len(spans):
            m = k
            while m < len(spans) and not keeps[m]:
                m += 1
            if m > k:
                a, b = spans[k][0], spans[m - 1][1]
                shared = [keeps[j] and count[data[slice(*spans[j])]] > 1 for j in range(len(spans))]
                n = sum(1 for j in range(a, b) if data[j] != 32 and (j == 0 or data[j - 1] == 32))
                a = max([a, *(spans[j][1] for j in range(k) if shared[j])])
                b = min([b, *(spans[j][0] for j in range(m, len(spans)) if shared[j])])
                if n >= substring_dedup.WORDS and a < b:
                    want.append((i, a, b))
            k = m + 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(pairs(substring_dedup.repeated_passages(df), "doc_id", "start", "end")) == sorted(want) and len(want) > 20


PEOPLE = "Mrs. Anna Smith met Mr Smith; Госпожа Анна Иванова. Mr. John A. Smith, Mr Jean-Luc Picard, Mr. O'Brien's car and Dr. Anna Smith. Anna Smith went; John A. Smith and Picard stayed."


def test_pii(spark, docs, empty):
    rows = [
        (1, "Call +1 (917) 555-2670 or 917-555-2670, mail Ann.Lee10@Mail9.example.com and ann.lee10@mail9.example.com."),
        (2, "Card 4207051279108084 vs 4207 0512 7910 8084, bad 4207051279108085. IP 71.77.118.93. SSN 123-45-6789"),
        (3, PEOPLE), (4, None), (5, ""), (6, "version 1.2.3.4.5, 12345678901234567890, a@b, it's \\d std::vector 12:30:45"),
        (7, "+49 30 1234567 or +49301234567; DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, DE00 3704 0044 0532 0130 00; 2001:db8::1 = 2001:0db8:0000:0000:0000:0000:0000:0001, FE80::AB:12"),
        (7, "again +49 30 1234567"), (None, "x@example.org " + "long " * 50_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("k")).withColumn("entity", F.lit(1))
    out = pii.replaced(df, key="secret", count_col="n")
    assert out.columns == ["doc_id", "text", "kind", "entity", "n"]
    every = out.collect()
    got = {r.doc_id: r for r in every if not (r.text or "").startswith("again")}
    assert got[4].text is None and got[5].text == "" and got[6].text == rows[5][1] and got[6].n == 0 and len(every) == len(rows)
    phones = re.findall(r"\(?\d{3}\)?[ -]\d{3}-\d{4}", got[1].text)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and "555-2670" not in got[1].text and "+1 (" in got[1].text
    mails = re.findall(r"[\w.]+@[\w.]+", got[1].text)
    assert len({m.lower().rstrip(".") for m in mails}) == 1 and mails[0][0].isupper() and ".com" in mails[0]
    cards = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", got[2].text)
    luhn = lambda c: sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, c))) % 10 == 0
    assert cards[0] == cards[1].replace(" ", "") and luhn(cards[0]) and cards[2] == "4207051279108085"
    assert got[2].n == 4 and pii.replaced(empty).count() == 0
    abroad = re.search(r"(\+49 \d\d \d{7}) or (\+49\d{9});", got[7].text)
    assert abroad[1].replace(" ", "") == abroad[2] != "+49301234567" and any(r.text == f"again {abroad[1]}" for r in every)
    german, british = re.search(r"(DE\d\d(?: \d{4}){4} \d\d), (GB\d\d[A-Z]{4}\d{14}), DE00 3704 0044 0532 0130 00", got[7].text).groups()
    rest = lambda x: int("".join(str(int(c, 36)) for c in x.replace(" ", "")[4:] + x[:4])) % 97
    assert rest(german) == rest(british) == 1 and "3704 0044 0532" not in german and "WEST" not in british
    short, long = re.search(r"([0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]) = (\S+),", got[7].text).groups()
    import ipaddress

    assert ipaddress.ip_address(short) == ipaddress.ip_address(long) != ipaddress.ip_address("2001:db8::1") and re.search(r"[0-9A-F]{4}::[0-9A-F]{2}:[0-9A-F]{2}$", got[7].text)
    assert got[None].text.endswith("long " * 50_000) and "x@example.org" not in got[None].text
    assert pii.replaced(docs).columns == docs.columns


def test_pii_names_keep_coreference_gender_and_script(spark):
    text = pii.replaced(spark.createDataFrame([(1, PEOPLE), (2, "Frau Smith")], "doc_id long, text string"), key="k").orderBy("doc_id").collect()
    pattern = r"Mrs\. (\w+) (\w+) met Mr (\w+); Госпожа (\w+) (\w+)\. Mr\. (\w+) (\w)\. (\w+), Mr (\w+)-(\w+) (\w+), Mr\. (\w+)'s car and Dr\. (\w+) (\w+)\. (\w+) (\w+) went; (\w+) (\w)\. (\w+) and (\w+) stayed\."
    g = re.fullmatch(pattern, text[0].text).groups()
    smith = g[1]
    assert {g[2], g[7], g[13], g[15], g[18]} == {smith} and text[1].text == f"Frau {smith}"
    assert g[0] == g[12] == g[14] and g[0] in pii.NAMES["f", "latin"] and g[3] in pii.NAMES["f", "cyrillic"] and re.fullmatch("[А-Я][а-яё]+", g[4])
    assert g[5] in pii.NAMES["m", "latin"] and (g[5], g[6]) == (g[16], g[17]) and g[8] in pii.NAMES["m", "latin"] and g[19] == g[10] != smith
    for real in ("Anna", "Smith", "John", "Jean", "Luc", "Picard", "Brien", "Иванова"):
        assert real not in (set(g) - {g[0], g[3]} if real == "Anna" else set(g))


def test_pii_against_brute_force(spark):
    """Entities found by a plain parser of made texts; one surrogate for each, none shared, none an entity."""
    rng, rows, want = random.Random(9), [], []
    for i in range(120):
        found, parts = [], []
        for _ in range(rng.randrange(6)):
            kind = rng.choice(["email", "ip", "ssn"])
            e = {"email": f"{rng.choice('abc')}{rng.randrange(12)}@{rng.choice('xy')}.org", "ip": f"10.0.{rng.randrange(3)}.{rng.randrange(30)}", "ssn": f"{rng.randrange(100, 130)}-45-6789"}[kind]
            found.append((kind, e))
            parts += [words(rng, rng.randrange(1, 4)), e]
        rows.append((i, " ".join([*parts, "end"])))
        want.append(found)
    out = {r.doc_id: r for r in pii.replaced(spark.createDataFrame(rows, "doc_id long, text string"), key="k", count_col="n").collect()}
    real, given = {e for f in want for e in f}, {}
    shape = {"email": r"[a-z0-9]+@[a-z]\.org", "ip": r"\d+\.\d+\.\d+\.\d+", "ssn": r"\d{3}-\d\d-\d{4}"}
    for i, found in enumerate(want):
        assert out[i].n == len(found)
        new = re.findall("|".join(shape.values()), out[i].text)
        assert len(new) == len(found) and all(re.fullmatch(shape[k], s) for (k, _), s in zip(found, new))
        for e, s in zip(found, new):
            assert given.setdefault(e, s) == s
    assert len(set(given.values())) == len(given) > 60 and not {(k, s) for (k, _), s in given.items()} & real


def test_pii_short_addresses_never_run_out(spark):
    rows = [(i, f"{i % 10}@{i // 10}.de") for i in range(100)]
    out = pii.replaced(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect()
    assert len({r.text for r in out}) == 100 and not {r.text for r in out} & {t for _, t in rows}


def test_pii_collisions_are_drawn_again(spark, monkeypatch):
    rows = [(i, f"ip 10.0.0.{i} and 10.0.0.{i % 7}") for i in range(1, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def few(kind, entity, attempt, key):  # a hundred surrogates, which collide often
        return F.concat(F.lit("9.9.9."), (F.conv(F.substring(F.sha2(F.concat_ws("|", entity, attempt.cast("string")), 256), 1, 4), 16, 10).cast("int") % 100).cast("string"))

    monkeypatch.setattr(pii, "surrogate", few)
    again = pii.attempts(pii.entities(df), "k")
    assert again is not None and again.count() > 0
    out = {r.doc_id: re.findall(r"[\d.]+", r.text) for r in pii.replaced(df, key="k").collect()}
    single = {f"10.0.0.{i}": out[i][0] for i in out}
    assert len(set(single.values())) == len(single)
    assert all(out[i][1] == single[f"10.0.0.{i % 7}"] for i in out if i % 7)


def test_pii_key(spark):
    import hmac

    for key in ("k", "k" * 100):
        assert spark.range(1).select(pii.mac(F.lit("grüße"), key)).first()[0] == hmac.new(key.encode(), "grüße".encode(), hashlib.sha256).hexdigest()
    assert pii.key_of(spark) == pii.key_of(spark) != "rowdelta" and len(pii.key_of(spark)) == 64
    df = spark.createDataFrame([(1, "a.b.c.d.e@example.com")], "doc_id long, text string")
    assert len({pii.replaced(df, key=k).first().text for k in ("a", "b")}) == 2


def test_vector_dedup(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    rows, n = [], 0
    for i, b in enumerate(base):
        for k in range(1 + i % 4):
            v = b + (0.12 * k) * rng.standard_normal(64)
            rows.append((n, i % 3, [float(np.float32(x)) for x in v]))
            n += 1
    rows += [(n, 1, rows[5][2]), (n + 1, rows[5][1], rows[5][2]), (n + 2, None, rows[0][2]), (n + 3, 0, None), (n + 4, 0, [0.0] * 64), (n + 5, 0, [float("nan")] * 64), (n + 6, 0, []), (n + 7, 0, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("rep", F.lit(1))
    fit = [(i, lab, np.array(v) / np.linalg.norm(v)) for i, lab, v in rows if lab is not None and v and len(v) == 64 and np.isfinite(np.array(v, float)).all() and any(v)]
    links, root = dict.fromkeys([r[0] for r in rows], 0), {r[0]: r[0] for r in rows}
    edges = [(a[0], b[0]) for a in fit for b in fit if a[0] < b[0] and a[1] == b[1] and a[2] @ b[2] >= 0.98]
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    for _ in rows:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.vec_id: (r.n_links, r.component) for r in vector_dedup.near_duplicates(df).collect()}
    assert len(edges) > 20 and got == {i: (links[i], root[i]) for i in links}
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vector_filters_hold_pairs_at_the_bound():
    rng = np.random.default_rng(1)
    a, o = rng.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    code = vector_dedup.ProductCode(64)
    lists = []
    for x in (a, b):
        row, filters = code.decode(x)
        lists.append(np.split(filters, np.flatnonzero(np.diff(row)) + 1))
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(*lists)]) > 0.995


def test_vectors_in_cells_of_two_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(32)
    rows = [(i, 1, (base + 0.18 * rng.standard_normal(32)).tolist()) for i in range(900)] + [(1000 + i, 1, rng.standard_normal(32).tolist()) for i in range(100)]
    rows += [(None, 1, rows[3][2]), (5, 1, rows[7][2]), (2000, 1, [1e200] * 32), (2001, 1, [1.1e200] * 31 + [1.0e200])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    x = np.array([r[2] for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    want = sorted((str(r[0]), int(n) - 1) for r, n in zip(rows, near.sum(1)))
    assert 1000 < near.sum() - len(rows)
    for limit in (64, 4096):
        got = sorted((str(i), n) for i, n in pairs(vector_dedup.near_duplicates(df, limit=limit), "vec_id", "n_links"))
        assert sum(n for _, n in got) >= 0.99 * sum(n for _, n in want) and all(g <= w for (_, g), (_, w) in zip(got, want))
    assert [vector_dedup.words_for(n) for n in (10, 50_000, 10_000_000)] == [16, 16, 93]


def test_vector_filters_with_more_directions_hold_pairs_too():
    rng = np.random.default_rng(2)
    a, o = rng.standard_normal((2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    for words_ in (32, 96):
        code, lists = vector_dedup.ProductCode(64, words=words_), []
        for x in (a, b):
            row, filters = code.decode(x)
            assert len(filters) < 90 * len(x)
            lists.append(np.split(filters, np.flatnonzero(np.diff(row)) + 1))
        assert np.mean([bool(set(p) & set(q)) for p, q in zip(*lists)]) > 0.99


def test_spanning_forests():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(2, 30))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 50))))
        label = np.arange(n)
        taken = vector_dedup.spanning(a, b, label)
        root = list(range(n))
        for x, y in zip(a.tolist(), b.tolist()):
            root = [min(root[x], root[y]) if r in (root[x], root[y]) else r for r in root]
        assert label.tolist() == root and len(taken) == n - len(set(root))


def test_anchors_and_tokens_in_cells_of_two_blocks(spark, docs):
    plain = {(r.doc_id, r.fp): r.component for r in simhash.near_duplicates(docs).collect()}
    assert plain == {(r.doc_id, r.fp): r.component for r in simhash.near_duplicates(docs, limit=2).collect()}


def test_frequent_shingles_go_last_and_change_nothing(spark):
    rng = random.Random(3)
    common = words(rng, 60)
    texts = [f"{common} {words(rng, 30)}" for _ in range(40)] + [f"{words(rng, 200)}" for _ in range(10)]
    texts += [t + " more" for t in texts[::7]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shingle_join.described(simhash.source_of(df, "doc_id", "text"), 5)
    late = shingle_join.frequent(rows, 30)
    assert len(late) == 56
    hashes = np.frombuffer(rows.where("doc = 0").first().hashes, np.uint64)
    assert not set(shingle_join.prefix(hashes, 0.8, late).tolist()) & set(late.tolist())
    want = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    sets = rows.withColumn("node", F.col("doc"))
    for order in (late, late[:0]):
        got = {frozenset(r) for r in pairs(components.components(shingle_join.candidates(shingle_join.tokens(sets, 0.8, order), 0.8)), "node", "component")}
        ends = {n for f in got for n in f}
        assert want and all(i in ends and j in ends for i, j in want)


def test_survivors_of_rows_that_share_an_id(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "red green blue black white brown pink")
    df = spark.createDataFrame([(1, a), (3, a), (3, b), (None, a), (None, c), (None, None), (4, None)], "doc_id long, text string")
    for how in (simhash.FIVE_WORDS, {}):
        left = sorted(map(str, pairs(simhash.survivors(df, **how), "doc_id", "text")))
        assert left == sorted(map(str, [(1, a), (3, b), (None, c), (4, None)]))


def test_exact_dedup_over_rows_in_another_order_each_time(spark):
    df = spark.createDataFrame([(i, f"text {i % 20}") for i in range(2000)], "doc_id long, text string").repartition(7).orderBy(F.rand())
    assert not exact_dedup._is_scan(df)
    got = pairs(exact_dedup.deduplicate(df), "doc_id", "keep_id", "group_size", "kept")
    assert sorted(got) == [(i, i % 20, 100, i < 20) for i in range(2000)]
    assert sorted(r.doc_id for r in exact_dedup.survivors(df).collect()) == list(range(20))


def test_components_and_counts_join_plain_scans(spark, docs, tmp_path):
    """No aggregate between a shuffle and a join that may be skewed."""
    spark.createDataFrame([(i, 0) for i in range(1, 50)], "u long, v long").write.parquet(str(tmp_path / "stars"))
    stars = spark.read.parquet(str(tmp_path / "stars"))
    plans = [x[0]._jdf.queryExecution().optimizedPlan().toString() for x in (components.large_star(stars), components.small_star(stars.selectExpr("u", "v")))]
    plans.append(token_counts.count_tokens(docs, str(tmp_path / "c"))._jdf.queryExecution().optimizedPlan().toString())
    assert all("Join" in p and "Aggregate" not in p for p in plans)


def test_token_counts_of_hits_and_misses(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    want = sorted(map(str, pairs(token_counts.count_tokens(docs, str(tmp_path / "other")), "doc_id", "n_tokens")))
    token_counts.count_tokens(docs.where("doc_id % 2 = 0"), cache)
    spark.read.parquet(cache).where("false").write.mode("append").parquet(cache)
    held = spark.read.parquet(cache).count()
    assert 0 < held and sorted(map(str, pairs(token_counts.count_tokens(docs, cache), "doc_id", "n_tokens"))) == want
    assert spark.read.parquet(cache).count() == spark.read.parquet(cache).select("content_digest").distinct().count() > held


def test_label_model_against_plain_em():
    """Without links the tree is empty: the posteriors are those of independent voters, by a plain loop."""
    rng = np.random.default_rng(0)
    y = rng.random(400) < 0.3
    right = np.array([0.9, 0.8, 0.7, 0.85])
    votes = np.where(rng.random((400, 4)) < right, np.where(y[:, None], 1, -1), np.where(y[:, None], -1, 1)) * (rng.random((400, 4)) < 0.8)
    got, accuracy, _ = toxicity._label_model(votes.astype(np.int8), 0.3, settled=0)
    p = [0.99 if s > 0 else 0.01 if s < 0 else 0.3 for s in votes.sum(1)]
    first = list(p)
    for _ in range(40):
        table = {}
        for j in range(4):
            for c in (0, 1):
                n = {v: 0.5 / 3 for v in (-1, 0, 1)}
                for i in range(400):
                    n[votes[i, j]] += (p[i] if c else 1 - p[i]) + toxicity.ANCHOR * (first[i] if c else 1 - first[i])
                table[j, c] = {v: x / sum(n.values()) for v, x in n.items()}
        odds = [0.3 / 0.7 * np.prod([table[j, 1][votes[i, j]] / table[j, 0][votes[i, j]] for j in range(4)]) for i in range(400)]
        p = [o / (1 + o) for o in odds]
    assert np.allclose(got, p, atol=1e-6) and ((got > 0.5) == y).mean() > 0.9 and accuracy.argmax() == 0


def test_label_model_links_voters_that_say_the_same():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.4
    vote = lambda right: np.where(rng.random(3000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    poor = vote(0.6)
    votes = np.column_stack([vote(0.85), vote(0.85), vote(0.85), poor, poor, poor]).astype(np.int8)
    p, accuracy, parent = toxicity._label_model(votes, 0.4, anchor=0.1)
    assert sum(parent[i] in (3, 4, 5) for i in (3, 4, 5)) >= 2
    assert ((p > 0.5) == y).mean() > 0.86 and accuracy[:3].min() > accuracy[3:].max()


def test_pipeline_keeps_a_representative_of_every_row_it_drops(spark):
    import corpus_pipeline

    rng = random.Random(11)
    base = [words(rng, 120) for _ in range(8)]
    rows = [(1, base[0]), (1, base[1]), (2, base[0]), (None, base[2]), (None, base[3]), (3, base[2]), (4, base[4] + " one more"), (4, base[4]), (5, "  " + base[1]), (6, None), (6, ""), (7, base[5]), (7, base[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("kept", F.lit(0)).withColumn("sid", F.lit("s"))
    once = corpus_pipeline.distinct(spark, df, "")
    assert once.columns == df.columns
    norm = lambda t: re.sub(r"\s+", " ", t or "")
    assert sorted(norm(r.text) for r in once.collect()) == sorted({norm(t) for _, t in rows})
    left = corpus_pipeline.unlike(spark, once, "")
    assert left.columns == df.columns
    kept, alike = sorted(norm(r.text).strip() for r in left.collect()), {base[4] + " one more", base[4]}
    assert len(kept) == len(set(kept)) and len(alike & set(kept)) == 1 and set(kept) | alike == {norm(t).strip() for _, t in rows}
    assert corpus_pipeline.private(spark, left, "").columns == df.columns
    empty = df.limit(0)
    assert all(f(spark, empty, "").count() == 0 for f in (corpus_pipeline.distinct, corpus_pipeline.unlike, corpus_pipeline.private, corpus_pipeline.packed))


def test_pipeline_on_the_smallest_tables(spark):
    import os

    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    out = corpus_pipeline.run(spark, d)
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    assert 0 < out.select("doc_id").distinct().count() <= n
    table = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, d).columns == table.columns


@pytest.mark.parametrize("most", [50_000, 0])
def test_rows_among_places(spark, monkeypatch, most):
    """By bitmaps, and by a join where these are beyond a broadcast's bounds."""
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", most)
    rng = random.Random(6)
    at = [0, 1, 7, 8, 32767, 32768, 65535, 1 << 33, (1 << 33) + 40_000, *rng.sample(range(200_000), 300)]
    rows = [(g, a, f"{g}{a}") for g in "xyz" for a in sorted(set(at))]
    some = [r[:2] for r in rows if r[0] < "z" and rng.random() < 0.4]
    big = spark.createDataFrame(rows, "file string, place long, wide string")
    with scratch.tables(spark):
        places = scratch.written(spark.createDataFrame(some + some[:9], "file string, place long"), "places")
        for inside in (True, False):
            got = pairs(scratch.among(big, places, "place", "file", inside), *big.columns)
            assert sorted(got) == [r for r in rows if (r[:2] in some) == inside]
        got = pairs(scratch.among(big, places.where("file = 'x'").select("place"), "place"), *big.columns)
        assert sorted(got) == [r for r in rows if ("x", r[1]) in some]
        assert scratch.among(big, places.where("false"), "place", "file").count() == 0
        assert scratch.among(big, places.where("false"), "place", "file", False).count() == len(rows)


def shuffled(spark, run):
    """Bytes of shuffles that run() writes where Spark broadcasts nothing by itself."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before, at = {k: spark.conf.get(k, None) for k in keys}, total()
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        run()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return total() - at


def test_token_counts_leave_texts_where_they_are(spark, tmp_path, monkeypatch):
    """With more digests than a broadcast holds, too, and where only some ids are asked for."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 20)
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(48):x}" for _ in range(300)) for _ in range(400)]
    texts += texts[:50] + [t.replace(" ", "\n") for t in texts[50:60]] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs, library = spark.read.parquet(str(tmp_path / "docs")), Tokenizer.from_file(tokens.vocabulary())
    some, cache, got = docs.where("doc_id % 3 = 0").select("doc_id"), str(tmp_path / "cache"), []

    def run():
        got.append(pairs(token_counts.count_tokens(docs, cache, ids=some), "doc_id", "n_bytes", "n_tokens"))
        got.append(pairs(token_counts.count_tokens(docs, cache), "doc_id", "n_bytes", "n_tokens"))

    moved = shuffled(spark, run)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert sorted(got[0]) == want[::3] and sorted(got[1]) == want
    assert spark.read.parquet(cache).count() == 401
    assert moved < 0.25 * sum(len(t or "") for t in texts)


def test_near_duplicates_leave_other_hashes_where_they_are(spark, tmp_path, monkeypatch):
    """Only texts with a candidate have their hashes shuffled; copies are left out without a shuffle of the others."""
    rng = random.Random(9)
    texts = [" ".join(f"{rng.getrandbits(32):x}" for _ in range(8000)) for _ in range(30)]
    texts += [texts[0] + " end", texts[1].upper(), texts[2] + " more"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs, left = spark.read.parquet(str(tmp_path / "docs")), []
    monkeypatch.setattr(shingle_join, "candidates", lambda points, least, limit: spark.createDataFrame([], "a long, b long"))  # the anchors alone find these
    moved = shuffled(spark, lambda: left.extend(r.doc_id for r in simhash.survivors(docs, **simhash.FIVE_WORDS).collect()))
    assert sorted(left) == list(range(30))
    assert moved < 8 * 8000 * 15


def test_workers_keep_one_coder_at_a_time(spark):
    made = []
    make = lambda x: lambda: made.append(x) or x
    assert [cache.kept(k, make(k)) for k in "aabba"] == [*"aabba"] and made == [*"aba"]
    cache.released()
    assert cache.kept("a", make("a")) == "a" and made == [*"abaa"]
    cache.released()
    first = tokens.encoder(tokens.vocabulary())
    assert tokens.encoder(tokens.vocabulary()) is first and tokens.encoder(tokens.vocabulary(), 10).kept.most == 10
    assert tokens.encoder(tokens.vocabulary()) is not first


def test_packing_with_few_kept_words(spark, docs):
    cols = ("doc_id", "start", "length", "ids", "doc_tokens")
    some = docs.where("doc_id <> 3").select("doc_id", "text").coalesce(1)
    assert sorted(pairs(packing.pack(some, words=10), *cols)) == sorted(pairs(packing.pack(some), *cols))


def test_batches_of_documents_are_bounded(spark):
    keys = (arrow.ROWS_KEY, arrow.SCANNED_KEY)
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        arrow.bounded(spark)
        assert [int(spark.conf.get(k)) for k in keys] == [arrow.ROWS, arrow.SCANNED]
        for k in keys:
            spark.conf.set(k, "77")
        arrow.bounded(spark)
        assert [spark.conf.get(k) for k in keys] == ["77", "77"]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
