"""Each training-data operator against brute force, and on null, empty, long, repeated and missing rows."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, decontaminate, html_text, language, line_dedup, near_vectors, ngram_join, quality, queries, suffix_dedup, token_counts

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n", "a", "a b c", "É é\tß\x0b ǅ", "x" * 70_000, "word " * 30_000, "same text here of some words", "same text here of some words", "🎉 日本 <|endoftext|> it's", "\x1c\x1d a\x85b"]


def odd(spark):
    """Texts with null and repeated ids, and columns named like outputs."""
    ids = [None if i == 3 else min(i, 10) for i in range(len(ODD))]
    return spark.createDataFrame([(i, t, "x", "en", 1, "s", 5) for i, t in zip(ids, ODD, strict=True)], "doc_id long, text string, n_tokens string, lang string, id int, source string, n_chars long")


def corpus(n=60, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 150))) for _ in range(n)]
    passage = " ".join(r.choice(words) for _ in range(60))
    for i in range(0, n, 4):
        texts[i] += "\n" + passage
    for i in range(1, n, 5):
        own = texts[i - 1].split(" ")
        own[r.randrange(len(own))] = "changed"
        texts[i] = " ".join(own)
    return texts + texts[:5]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fuzz(n=3000):
    r = random.Random(2)
    alphabet = "abcdeé ßñ\n\t  ' ́Σσς…、日本🎉12  AB<|endoftext|>!?\x1c\x85​"
    runs = ["".join(r.choice("abthein") for _ in range(3000)), "a" * 2000, "th" * 1500 + "e", "é" * 900]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)] + runs + [t or "" for t in ODD if t is None or len(t) < 60_000]


def test_token_counts(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = fuzz()
    assert token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"), 1 << 12).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    long = ["\x1c\x1d,a b!\x1c \x1f" * 3000, "漢字、かな。" * 4000, "abc123,x!y'll" * 3000, "don't won't 1st\x1c 2nd\u3000" * 2000, "x" * 9000 + "1" * 9000]
    assert token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"), 1 << 12).counts(long) == [len(e.ids) for e in library.encode_batch(long, add_special_tokens=False)]
    assert all("".join(token_counts.slices(t, 4096)) == t and max(map(token_counts.size_of, token_counts.slices(t, 4096))) < 5000 for t in long[:-1])
    assert [token_counts.size_of("".join(run)) for run in token_counts.by_bytes(["é" * 50] * 100, 1000)] == [1000] * 10
    rows = token_counts.count_tokens(odd(spark), "byte_bpe_50k.json").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) and r.over_limit == (r.n_tokens > 1024)
    assert token_counts.count_tokens(odd(spark).limit(0), "byte_bpe_50k.json").count() == 0


def test_bpe_codec(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    for text in fuzz():
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and codec.decode(ids, True) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode(codec.encode("Hello, Wörld! 日本")) == "hello , wörld ! 日本 "
    whole = "Long wörds and\u3000gaps " * 120_000 + "x" * 50_000 + " end"  # several parts
    ids = library.encode(whole, add_special_tokens=False).ids
    n, ids_hash, text_hash = codec.digest(whole)
    assert n == len(ids) and ids_hash == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert text_hash == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert max(len(w) for w in codec.words(whole)) < 300_000
    for r in bpe.encode_decode(odd(spark), "word_bpe_49k.json", ids=True).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.token_ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(odd(spark).limit(0), "word_bpe_49k.json").count() == 0


def test_transducer_keeps_a_bounded_window():
    v = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    moving, most, n = bpe.Transducer(v), 0, 0
    for i in range(20_000):
        n += len(moving.push(bytes([97 + i * 7 % 26])))
        most = max(most, len(moving.pending))
    assert most <= moving.window + 1 and n > 1000
    symbols = [v.inner[97 + i * 7 % 26] for i in range(20)]
    assert all(v._few(symbols[i:j]) == v._many(symbols[i:j]) for i in range(20) for j in range(i + 2, 21))


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    got = language.predict(docs.where(language.held_out()), model).select("lang", "lang_pred", "score", "rejected").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all() and got["rejected"].mean() < 0.02
    rows = language.predict(odd(spark), model).collect()
    assert len(rows) == len(ODD) and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert all(r.rejected and r.score == 0 for r in rows if r.lang_pred == "und")
    numerals = spark.createDataFrame([(1, "½ ² ① Ⅷ 12 _"), (2, "½ a")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language.predict(numerals, model).orderBy("doc_id").collect()] == [True, False]
    assert list(language.words_of("ab cd" * 300_000)) != [] and sum(len(w) for w in language.words_of("ab " * 1_000_000)) == 1_000_000
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.predict(odd(spark), none).collect()} == {"und"}
    assert language.predict(odd(spark).limit(0), model).count() == 0


def test_language_bounds_of_few_documents(spark):
    """Languages of few training documents reject what is foreign to them, and not their own."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    few = docs.where("lang = 'en' OR doc_id % 8 = 0")
    model = language.fit(few)
    assert np.isfinite(model.bound).all()
    junk = spark.createDataFrame([(i, " ".join(c * 9 for c in "дзъжqxwю" * 20)) for i in range(3)], "doc_id long, text string")
    assert all(r.rejected for r in language.predict(junk, model).collect())
    got = language.predict(few, model).select("lang", "lang_pred", "rejected").toPandas()
    assert got["rejected"].mean() < 0.02 and got[got["lang"] != "en"]["rejected"].mean() < 0.05
    one = language.fit(docs.where("lang = 'en'").limit(1))
    assert np.isfinite(one.bound).all() and all(r.rejected for r in language.predict(junk, one).collect())


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    rows = quality.prepare(docs)
    model = quality.fit(rows, train.withColumn("i", F.lit(1)).withColumn("y", F.lit(0)))
    got = quality.score(docs, model).join(test, "doc_id").toPandas()
    assert (got["quality"] == got["quality_pred"]).mean() > 0.9
    same = {r.doc_id: r.score for r in quality.score_rows(rows, model).collect()}
    assert len(same) == docs.count() and all(abs(same[k] - v) < 1e-6 for k, v in zip(got["doc_id"], got["score"], strict=True))
    assert quality.score(odd(spark), model).count() == len(ODD) and quality.score(odd(spark).limit(0), model).count() == 0
    clashing = odd(spark).withColumn("i", F.lit(1)).withColumn("y", F.lit(0)).withColumn("u", F.lit(0)).withColumn("t", F.lit("x"))
    strange = quality.prepare(clashing)
    assert quality.score_rows(strange, model).count() == len(ODD) and quality.score_rows(quality.prepare(clashing.limit(0)), model).count() == 0
    few = spark.createDataFrame([(k % 11, k % 2) for k in range(22)] + [(None, 1), (4, None)], "doc_id long, quality int")
    assert quality.score_rows(strange, quality.fit(strange, few)).count() == len(ODD)
    none = quality.fit(rows, labels.limit(0))
    assert {r.score for r in quality.score(odd(spark), none).collect()} == {0.5}


def test_quality_learns_from_all_unlabelled(spark):
    """A source whose documents come last by hash of the id, behind 6500 others, has a metadata weight."""
    order = [r.id for r in spark.range(7040).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, "a clear and plain story of the day" if i % 2 else "BUY now!!! cheap cheap click", "rare" if k >= 6540 and i % 2 else "web", "en", 30) for k, i in enumerate(order)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in order[:40]], "doc_id long, quality int")
    model = quality.fit(quality.prepare(docs), labels)
    at = quality.meta_row("rare", "en", 30)[0]
    assert model.views[1].w[at[0]] > 0 and model.views[1].w[at[3]] > 0


def leaks(texts, items):
    words = lambda t: (t or "").lower().split()
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    found = set()
    for d, t in enumerate(texts):
        w = words(t)
        for k, item in enumerate(items):
            n, own = len(words(item)), collections.Counter(runs(words(item)))
            for s in range(max(1, len(w) - n + 1)) if w and own and (n >= 5 or len(w) < 5) else ():
                have = collections.Counter(runs(w[s : s + n]))
                both = sum((have & own).values())
                if both >= 0.8 * (sum(have.values()) + sum(own.values()) - both):
                    found.add((d, k))
    return found


def test_decontamination(spark):
    texts = corpus(30)
    r = random.Random(3)
    items = [" ".join(t.split()[:40]) for t in texts[:8]] + ["one two three", "", None]
    near = items[0].split()
    near[20] = "other"
    texts += ["before " * 9 + " ".join(near) + " after", "so one two three it is", "one two three", None, ""]
    r.shuffle(texts)
    docs, bench = frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.id, x.item_id) for x in decontaminate.contaminated(docs, bench).collect()}
    want = leaks(texts, items)
    assert got == want and len(want) > 8
    clean = {x.doc_id for x in decontaminate.decontaminate(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_decontamination_of_odd_rows(spark):
    """Null and repeated ids, null, empty and very long texts, clashing names."""
    items = ["same text here of some words", "a b c", "word " * 40, None, "", "a b c"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = odd(spark).withColumn("i", F.lit(1)).withColumn("k", F.lit(2)).withColumn("key", F.lit(3)).withColumn("start", F.lit(4)).cache()
    dirty = {d for d, _ in leaks(ODD, items)}
    assert {ODD[d] for d in dirty} == {"same text here of some words", "a b c", "word " * 30_000}
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert collections.Counter(r.text for r in left.collect()) == collections.Counter(t for i, t in enumerate(ODD) if i not in dirty)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_decontamination_of_a_long_repetitive_text(spark):
    r = random.Random(4)
    phrase = [f"w{i}" for i in range(7)]
    text = [phrase[i % 7] for i in range(20_000)]
    item = [phrase[i % 7] for i in range(30)]
    item[11] = "other"
    other = [f"x{r.randrange(50)}" for _ in range(300)]
    texts, items = [" ".join(text), " ".join(other), "none of these"], [" ".join(item), " ".join(other[10:150]), " ".join(phrase * 3)]
    got = {(x.id, x.item_id) for x in decontaminate.contaminated(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == leaks(texts, items) and {(0, 2), (1, 1)} <= got


def test_decontamination_of_swapped_halves(spark):
    r = random.Random(11)
    items = [[f"w{r.randrange(10**6)}" for _ in range(n)] for n in (50, 80, 120)]
    texts = [" ".join(["before"] * 30 + w[len(w) // 2 :] + w[: len(w) // 2] + ["after"] * 30) for w in items]
    items = [" ".join(w) for w in items]
    got = {(x.id, x.item_id) for x in decontaminate.contaminated(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == leaks(texts, items) == {(0, 0), (1, 1), (2, 2)}


@pytest.mark.parametrize("name", ["op5_line_dedup", "op4_benchmark_decontamination", "op6_suffix_dedup", "op8_near_vectors", "op10_ngram_join"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(queries.oracle_sql()[name]).df()[cols]
    text = lambda rows: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert text(tuple(r[c] for c in cols) for r in df.collect()) == text(want.itertuples(index=False))


def test_line_runs(spark):
    run = "one two three four\nfive six seven eight\nnine ten eleven"
    texts = [f"head of the first\n{run}\ntail", f"{run}", f"x\n\n{run}\n\ny", "one two three four", run + "\n" + run, None, ""]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert [got[i].text for i in range(7)] == [texts[0], "", "x\n\n\ny", texts[3], "", None, ""]
    assert got[2].n_removed_lines == 3 and got[5].n_lines == 0
    clashing = odd(spark).withColumn("i", F.lit(1)).withColumn("k", F.lit(2)).withColumn("g", F.lit(3)).withColumn("__id", F.lit(4)).withColumn("key", F.lit(5))
    out = line_dedup.dedup_lines(clashing)
    assert out.columns[:-2] == clashing.columns and collections.Counter(r.text for r in out.collect()) == collections.Counter(ODD)
    assert line_dedup.dedup_lines(odd(spark)).count() == len(ODD) and line_dedup.dedup_lines(odd(spark).limit(0)).count() == 0


def test_suffix_ranks(spark):
    """Ranks at each depth against the sorted suffixes; repeated rows are one document."""
    r = random.Random(12)
    docs = [[r.choice("abcdef") if r.random() < 0.8 else f"only {i} {k}" for k in range(40)] for i in range(12)]
    rows = frame(spark, ["\n".join(d) for d in docs] + ["\n".join(docs[0])]).withColumn("doc_id", F.when(F.col("doc_id") == 12, 0).otherwise(F.col("doc_id")))
    got = line_dedup.suffix_ranks(line_dedup.line_table(rows, "doc_id", "text"), 10).collect()
    assert len(got) == len({(x.id, x.at) for x in got}) == sum(len(line) == 1 or not i for i, d in enumerate(docs) for line in d)  # of the repeated row all lines occur again
    for j in range(4):
        runs = {(x.id, x.at): tuple(docs[x.id][x.at : x.at + (1 << j)]) for x in got}
        count = collections.Counter(v for v in runs.values() if len(v) == 1 << j)
        known = {(x.id, x.at): x[f"r{j}"] for x in got if x[f"r{j}"] is not None}
        if j:
            assert set(known) == {k for k, v in runs.items() if count[v] > 1}
        assert len(set(known.values())) == len({runs[k] for k in known}) == len({(runs[k], v) for k, v in known.items()})


def test_suffix_array_of_lines(spark):
    """Order, common prefixes and intervals against the sorted suffixes, copies beyond the depth of a run and a frequent line among them."""
    r = random.Random(13)
    copied = [r.choice("abcd") for _ in range(30)]
    docs = [[r.choice("abcdef") if r.random() < 0.9 else f"only {i} {k}" for k in range(40)] for i in range(8)] + [["a"] * 25, ["a"] * 21, copied + ["e"], copied + ["f"], copied]
    ranks = line_dedup.suffix_ranks(line_dedup.line_table(frame(spark, ["\n".join(d) for d in docs]), "doc_id", "text"))
    found = [(x["rank"], x.id, x.at) for x in ranks.collect()]
    places, lines = {x.at: x for x in ranks.collect() if x.id == 8}, {x.r0: docs[x.id][x.at] for x in ranks.collect()}
    assert len({x["rank"] for x in places.values()}) == 25  # runs of one line, longer than any depth looked at
    order = {line: n for n, line in lines.items()}
    counts = collections.Counter(line for d in docs for line in d)

    def suffix(i, at):
        end = next((k for k in range(at, len(docs[i])) if counts[docs[i][k]] == 1), len(docs[i]))
        return [order[line] for line in docs[i][at:end]]

    want = sorted((suffix(i, at), i, at) for i, d in enumerate(docs) for at, line in enumerate(d) if counts[line] > 1)
    assert [p[1:] for p in sorted(found)] == [p[1:] for p in want]
    for parts in ("4", "1"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == "1").lower())
        rows = sorted(line_dedup.intervals(line_dedup.suffixes(ranks, 10)).collect(), key=lambda x: (x["rank"], x.id, x.at))
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        mine = [s for s in want if len(s[0]) >= 10]  # lines of one word each
        assert [(x.id, x.at) for x in rows] == [s[1:] for s in mine] and all(x.depth == 10 for x in rows)
        shared = [0] + [next((k for k, (x, y) in enumerate(zip(a[0], b[0])) if x != y), min(len(a[0]), len(b[0]))) for a, b in zip(mine, mine[1:])]
        assert [x.lcp for x in rows] == [min(n, 10) for n in shared]
        assert len({x.interval for x in rows}) == len({tuple(s[0][:10]) for s in mine}) == len({(x.interval, tuple(s[0][:10])) for x, s in zip(rows, mine)})


def test_short_and_unspaced_line_runs(spark):
    paragraph = "这一段文字没有空格但是在许多文件里面反复出现"
    texts = [f"first\n{paragraph}", f"second\n{paragraph}", "third\nAll rights reserved by us.\nshort", "fourth\nAll rights reserved by us.\nshort"]
    got = [r.text for r in line_dedup.dedup_lines(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [texts[0], "second", *texts[2:]]
    got = [r.text for r in corpus_pipeline.drop_repeated_lines(spark, frame(spark, texts), SF).orderBy("doc_id").collect()]
    assert got == [texts[0], "second", texts[2], "fourth\nshort"]


def brute_spans(texts, length):
    seen, datas = collections.Counter(), [(t or "").encode() for t in texts]
    for d in datas:
        seen.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        on = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                on[i] += 1
                on[i + length] -= 1
        gone = np.cumsum(on)[:-1] > 0
        left = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), len(d) - len(left), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("many", [2000, 5, 1])
def test_suffix_dedup(spark, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    texts = corpus(40) + [t for t in ODD if t is None or len(t) < 100] + ["ab" * 400, "é" * 300]
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, 200)
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_index_of_batches(spark):
    """Batches one after the other against brute force over all that came before; few levels remain."""
    texts = corpus(48, 21) + ["ab" * 300, None, "short"]
    random.Random(2).shuffle(texts)
    index, done = suffix_dedup.Index(), []
    for i in range(0, len(texts), 14):
        batch = texts[i : i + 14]
        done += batch
        got = {r[0]: tuple(r[1:]) for r in index.add(frame(spark, batch)).collect()}
        assert [got[k] for k in range(len(batch))] == brute_spans(done, 200)[len(done) - len(batch) :]
    assert all(a.size > 2 * b.size for a, b in zip(index.levels, index.levels[1:])) and len(index.levels) < 4


def test_suffix_dedup_of_a_long_text(spark):
    """A text of several parts: repeats within it, across the parts' edges and in another text."""
    r = random.Random(5)
    long = "".join(r.choice("abcdefghij ") for _ in range(suffix_dedup.PART + 30_000))
    edge = suffix_dedup.PART
    texts = [long + long[1000:1500] + "é" * 10, "x " + long[edge - 300 : edge + 300] + " y", long[edge - 250 : edge - 20]]
    got = {x[0]: tuple(x[1:]) for x in suffix_dedup.remove_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(3)] == brute_spans(texts, 200)


def test_family_levels():
    r = random.Random(4)
    strings = [bytes(r.choice(b"ab") for _ in range(60)) for _ in range(80)]
    family, n = suffix_dedup.Family(12), 49
    for i in range(0, 80, 8):
        family.add(strings[i : i + 8])
    seen = collections.Counter(s[i : i + 12] for s in strings for i in range(n))
    assert family.marks.tolist() == [seen[s[i : i + 12]] > 1 for s in strings for i in range(n)] and len(family.levels) < 6


def test_suffix_array():
    r = np.random.default_rng(1)
    ids = r.integers(0, 3, 200)
    order, lcp = html_text.suffix_array(ids)
    assert order.tolist() == sorted(range(200), key=lambda i: ids[i:].tolist())
    for seed, n, kinds in ((2, 300, 2), (3, 1, 5), (4, 50, 1), (5, 120, 40)):
        ids = np.random.default_rng(seed).integers(0, kinds, n)
        order, lcp = html_text.suffix_array(ids)
        rows = [ids[i:].tolist() for i in order]
        assert rows == sorted(rows)
        assert lcp.tolist()[1:] == [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(rows, rows[1:])]
    assert len(html_text.suffix_array(np.zeros(0, np.int64))[0]) == 0
    assert html_text.repeated_blocks([[1, 2, 3], [4, 2, 3], [5]], [1, 1, 2]) == {2, 3, 5}


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script><style>p{}</style></head><body><nav><a>menu</a></nav><!-- x --><div class='ad'>buy</div><article><header><h1>Head &amp; line</h1></header><p>One\n  two<br>three<p>four &eacute;&#33;<form>f</form><div id=comments>c</div></article><footer>&copy;</footer>"
    shared = "<body><div>Shared line</div><div>{}</div></body>"
    rows = [(1, "http://h/a", page), (2, "http://g/a", shared.format("mine")), (3, "http://g/b", shared.format("yours")), (4, "http://k/", shared.format("alone")), (5, None, None), (5, "", ""), (6, "http://h/t", "<article><p>cut off <b")]
    got = {(r.page_id, r.url): r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = {k: r.text for k, r in got.items()}
    assert text[1, "http://h/a"] == "Head & line\nOne two three\nfour é!"
    assert (text[2, "http://g/a"], text[3, "http://g/b"], text[4, "http://k/"]) == ("mine", "yours", "Shared line\nalone")
    assert text[5, None] == text[5, ""] == "" and text[6, "http://h/t"] == "cut off" and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_blocks():
    blocks = lambda page: html_text.blocks_of(page)[0]
    assert blocks('<article><p class="advert">Buy now</p><p>text</p><span class="share">Share this</span>') == ["text"]
    assert blocks('<article><p class="advert">Buy now<p>text <span class="share">Share</span> more</article>') == ["text more"]
    assert blocks('<article><p title="x>hello</p><p>next</p>') == ["hello", "next"]
    assert blocks("<article><p>a<ul><li class=share>x<li>y</ul><p>z</article>") == ["a", "y", "z"]
    assert blocks("<article><a class='share' href=x>s<p>kept</p></article>") == ["kept"]
    assert blocks("<div class='related'><div>x</div>y</div>z &lt;b&gt;") == ["z <b>"]
    assert blocks("") == [] and blocks("<") == ["<"] and len(blocks("<article>" + "<p>one</p>" * 20_000 + "x" * 500_000)) == 20_001


def test_html_runs_of_whole_streams(spark, monkeypatch):
    """Menus and footers of settled pages take part in the host's suffix arrays; articles are kept, and are no reason to drop a block."""
    settled = "<nav><a>Home of news</a></nav><article><p>Shared paragraph</p><div>About</div><p>Own {}</p></article><div class=ad>Buy {}</div><footer>Imprint here</footer>"
    plain = "<body><div>Home of news</div><div>Shared paragraph</div><div>Mine alone</div><div>Imprint here</div></body>"
    rows = [(i, f"http://h/{i}", settled.format(i, i)) for i in range(6)] + [(6, "http://h/6", plain), (7, "http://other/7", plain)]
    assert html_text.stream_of(settled)[0] == ["Home of news", "Shared paragraph", "About", "Own {}", "Buy {}", "Imprint here"]
    assert html_text.stream_of("<p>a<span class=share>b</span>c<form>d</form>") == (["b", "ac"], [False, True], False)
    for group in (500, 1):
        monkeypatch.setattr(html_text, "GROUP", group)
        got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert [got[i] for i in range(6)] == [f"Shared paragraph\nAbout\nOwn {i}" for i in range(6)]
        assert got[6] == "Shared paragraph\nMine alone" and got[7] == "Home of news\nShared paragraph\nMine alone\nImprint here"


def test_html_runs_of_a_large_host(spark):
    """A notice on two pages goes, however many pages its host has."""
    page = "<body><div>own {}</div><div>notice {}</div></body>"
    rows = [(i, f"http://large/{i}", page.format(i, i % 1000)) for i in range(1040)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"own {i}" if i % 1000 < 40 else f"own {i}\nnotice {i}") for i in range(1040))


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    r = np.random.default_rng(6)
    x = r.normal(size=(40, 8))
    x = np.concatenate([x, x[:20] + r.normal(size=(20, 8)) * 0.1, x[:5], x[:3] * 2.0])
    bad = [None, [], [0.0] * 8, [None] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, v) for i, v in enumerate(bad)]
    got = {r.vec_id: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    want = classes(np.argwhere(close).tolist(), range(len(x)))
    assert all(got[i].n_links == close[i].sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(len(x)))
    assert all(got[100 + i].n_links == 0 and got[100 + i].kept for i in range(len(bad)))
    assert near_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def clustered(n, dim=32, seed=3):
    """Half of the vectors are near copies of others at cosines about 0.95, the rest lie in loose clusters."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n // 200 + 1, dim))[r.integers(0, n // 200 + 1, n // 2)] + 0.8 * r.normal(size=(n // 2, dim))
    x = np.concatenate([x, x + 0.045 * np.linalg.norm(x, axis=1, keepdims=True) * r.normal(size=x.shape)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("cells", [2048, 6])
def test_vector_recall(spark, cells, monkeypatch):
    """Against all pairs, with cells of one level, and of two where few are allowed; single and double precision."""
    monkeypatch.setattr(near_vectors, "MOST_CELLS", cells)
    monkeypatch.setattr(near_vectors, "CELL", 100)
    monkeypatch.setattr(near_vectors, "BLOCK", 200)
    monkeypatch.setattr(near_vectors, "VISITORS", 700)
    monkeypatch.setattr(near_vectors, "SLICE", 900)
    for kind in ("float", "double"):
        x = clustered(6000).astype(np.float32 if kind == "float" else np.float64)
        u = x.astype(np.float64)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        close = u @ u.T >= 0.95
        np.fill_diagonal(close, False)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
        got = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(df).collect()}
        assert close.sum() > 2000 and sum(got.values()) >= 0.97 * close.sum() and all(got[i] <= close[i].sum() for i in got)


def test_vector_recall_of_the_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = near_vectors.near_duplicates(vectors).agg(F.sum("n_links")).first()[0]
    assert found >= 0.97 * ((x @ x.T >= 0.95).sum() - len(x))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(texts):
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, classes(pairs, range(len(sets)))


def test_ngram_join(spark):
    base = corpus(1, 9)[0] + " tail" * 3 + " " + " ".join(f"w{i}" for i in range(120))
    r = random.Random(8)
    many = []
    for _ in range(40):  # a group whose members link to some of the others only
        own = base.split(" ")
        for _ in range(3):
            own[r.randrange(len(own))] = f"n{r.randrange(10**6)}"
        many.append(" ".join(own))
    texts = corpus(50) + many + [t for t in ODD]
    got = {r.doc_id: r for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    sets, want = linked(texts)
    assert all(got[i].n_shingles == len(sets[i]) and got[i].component_id == want[i] for i in range(len(texts)))
    assert ngram_join.near_duplicates(odd(spark)).count() == len(ODD) and ngram_join.near_duplicates(odd(spark).limit(0)).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Null and repeated ids, odd texts, columns named like the operators' own, and an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    strange = [*ODD, *ODD[-4:-2], "some more words that no other text has here", "some more words that no other text has here"]
    ids = [*(None if i % 5 == 3 else min(i, 9) for i in range(len(strange) - 1)), len(strange) - 2]
    extra = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, strange, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra)
    for name in ("score", "rejected", "lang_pred", "n_lines", "n_tokens", "i", "k", "key", "node", "c0", "windows"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    docs = docs.cache()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r.score == "own score" and r.n_lines == "own n_lines" and r.c0 == "own c0" for r in rows), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.encode(spark, docs.limit(0), SF).count() == 0
    rows = docs.collect()
    sets, want = linked([r.text for r in rows])
    kept = corpus_pipeline.keep_one_of_each_class(spark, docs, SF).collect()
    members = collections.defaultdict(list)
    for i, r in enumerate(rows):
        members[want[i] if sets[i] else ("none", i)].append(r)
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    expected = collections.Counter(min(map(order, m)) for m in members.values())
    assert collections.Counter(map(order, kept)) == expected
    assert collections.Counter(r.text for r in kept if not shingles(r.text)) == collections.Counter(r.text for r in rows if not shingles(r.text))


def test_pipeline(spark):
    """Each stage on all its predecessor kept; two of them against brute force on the way."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(docs.columns) <= set(out.columns) and len(out) > 0.7 * docs.count() and out["doc_id"].is_unique
    now = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
    rows = now.orderBy("doc_id").collect()
    _, want = linked([r.text for r in rows])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    first = [r for i, r in enumerate(rows) if want[i] == i]
    dirty = {d for d, _ in leaks([r.text for r in first], items)}
    assert {r.doc_id for i, r in enumerate(first) if i not in dirty} == set(out["doc_id"].tolist())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in out.head(20).itertuples():
        assert r.n_tokens == len(library.encode(r.text, add_special_tokens=False).ids)
