"""Corpus operators against plain versions, and on rows that are odd."""

import itertools
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratalog.llm import queries
from stratalog.llm.common import crc_bucket
from stratalog.llm.decontaminate import contaminated, local_alignment, word_list
from stratalog.llm.eliasfano import EliasFano
from stratalog.llm.embedding_dedup import near_duplicate_vectors
from stratalog.llm.language_id import identify
from stratalog.llm.learning import isotonic
from stratalog.llm.line_dedup import line_dedup
from stratalog.llm.minhash_dedup import near_duplicates
from stratalog.llm.packing import BestFit, pack, pack_documents
from stratalog.llm.quality import score_quality
from stratalog.llm.token_counts import PrefixCounter, count_tokens
from stratalog.llm.token_files import read_token_files, write_token_files
from stratalog.llm.tokens import public_path
from stratalog.llm.toxicity import CLASSES, CLAUSE_TRANSDUCER, Grammar, INSULTS, run_clause, score_toxicity

SF, SF2, SF3 = (f"/root/testdata/{x}" for x in ("sf0.001", "sf0.01", "sf0.1"))
BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
LONG = "one rather long line of words that goes on and on " * 4000
ODD = [None, "", " ", "a", "A", "one two three", "one two three", "\n\n\n", "éß \U0001f600 中文", "x" * 50_000, LONG, LONG + "tail"]


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


# near copies


def shingles(text, width):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()


def components(n, links):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return [find(i) for i in range(n)]


def brute_near_copies(texts, width):
    sets = [shingles(t, width) for t in texts]
    return sets, [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]


@pytest.mark.parametrize("width", [2, 5])
def test_near_copies_match_brute_force(rows, width):
    rng = random.Random(width)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 200))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for k in range(400):  # the first base has a large group of near copies
        b = list(base[0] if k < 180 else rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            b[rng.randrange(len(b))] = f"w{rng.randrange(3000)}"
        texts.append(" ".join(b))
    texts += ODD
    sets, links = brute_near_copies(texts, width)
    got = {r["doc_id"]: r for r in near_duplicates(rows(texts), width=width).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == components(len(texts), links)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]


@pytest.mark.parametrize("block, wide", [(1024, 256), (4, 256), (8, 64)])
def test_long_lists_lose_no_link(rows, block, wide):
    """Drifting copies: neighbours are linked, while most members of a long list are not."""
    rng = random.Random(9)
    base, texts = [f"w{i}" for i in range(90)], []
    for step in range(120):
        if step % 40 == 0:
            for at in rng.sample(range(20, 90), 30):
                base[at] = f"b{step}x{at}"
        base[rng.randrange(20, 90)] = f"n{step}"
        texts.append(" ".join(base))
    sets, links = brute_near_copies(texts, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(rows(texts), width=2, block=block, wide=wide).collect()}
    want = components(len(texts), links)
    assert len(set(want)) > 1 and [got[i] for i in range(len(texts))] == want


def test_near_copies_of_nothing(rows):
    assert near_duplicates(rows(["a"]).where("false")).collect() == []


# lines


def brute_lines(texts, least=10):
    space = " \t\n\v\f\r"
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(space))
    held = defaultdict(set)
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    drop = lambda i, line: len(held.get(key(line), ())) > 1 and i != min(held[key(line)])
    return ["\n".join(x for x in (t or "").split("\n") if not drop(i, x)) for i, t in enumerate(texts)]


def test_lines_match_brute_force(rows):
    rng = random.Random(3)
    pool = [f"  Line number {i} of the pool\t" for i in range(30)] + ["short", "", "Été à la plage"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(150)] + ODD
    out = {r["doc_id"]: r for r in line_dedup(rows(texts)).collect()}
    want = brute_lines(texts)
    assert [out[i]["kept_text"] for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        lines, runs = (t or "").split("\n"), out[i]["keep_runs"]
        keep = [n % 2 == 0 for n, length in enumerate(runs) for _ in range(length)]
        assert len(keep) == len(lines) == out[i]["n_lines"]
        assert "\n".join(x for x, k in zip(lines, keep) if k) == want[i]


def test_lines_pass_other_columns_on(rows):
    out = line_dedup(rows(["first line of all"] * 2))
    assert {"lang", "source", "dropped", "lines", "row", "id"} <= set(out.columns) and out.columns.count("n_lines") == 1
    assert {(r["dropped"], r["row"]) for r in out.collect()} == {("other", "other")}
    assert line_dedup(rows(["a"]).where("false")).collect() == []


# tokens


@pytest.mark.parametrize("sf", [SF])
def test_token_counts_are_the_librarys(spark, sf):
    tok = Tokenizer.from_file(public_path(BYTES))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op6_token_counts(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {
        i: (len((t or "").encode()), n := len(ids_of(tok, t)), n > 1024) for i, t in texts.items()
    }


def test_token_counts_of_odd_texts(rows):
    tok = Tokenizer.from_file(public_path(BYTES))
    texts = ODD + ["<|endoftext|> a<|endoftext|>", "it's we'll  two  spaces \n \n x", "tab\tand\r\nbreak", "12345 67.89", " lead", "trail ", "a\n\nb", " x y"]
    got = {r["doc_id"]: r for r in count_tokens(rows(texts), public_path(BYTES)).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(ids_of(tok, t)) for t in texts]
    for i, t in enumerate(texts):
        n = got[i]["limit_chars"]
        assert n == len(t or "") or len(ids_of(tok, t[:n])) <= 1024


def test_every_prefix(spark):
    tok, counter = Tokenizer.from_file(public_path(BYTES)), PrefixCounter(public_path(BYTES))
    for text in ("The quick, brown fox's den. Zwei Wörter", "abc\nxyz 12 34"):
        assert counter.prefixes(text).tolist() == [len(ids_of(tok, text[:i])) for i in range(len(text) + 1)]


def test_token_files_round_trip(spark, rows, tmp_path):
    tok = Tokenizer.from_file(public_path(BYTES))
    for k, docs in enumerate((rows(ODD), rows(["a"]).where("false"), spark.read.parquet(f"{SF}/documents.parquet"))):
        path = f"file://{tmp_path}/{k}"
        write_token_files(docs, path, public_path(BYTES), shard_ids=5000)
        got = sorted(read_token_files(spark, path).collect())
        start, want = 0, []
        for r in sorted(docs.select("doc_id", "text").collect()):
            ids = ids_of(tok, r["text"]) + [0]
            want.append((r["doc_id"], start, len(ids), crc(ids)))
            start += len(ids)
        assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 0), (1, 0), (1, 9), (700, 300), (1000, 10**7)):
        v = np.sort(rng.integers(0, top + 1, n))
        code = EliasFano.encode(v, top)
        assert code.decode().tolist() == v.tolist() == [code.select(i) for i in range(n)]
    assert len(code.low) + len(code.high) < 1000 * 17 / 8


# packing


@pytest.mark.parametrize("odd", [True, False])
def test_packing(spark, rows, odd):
    tok = Tokenizer.from_file(public_path(WORDS))
    docs = rows(ODD) if odd else spark.read.parquet(f"{SF}/documents.parquet")
    out = pack_documents(docs, public_path(WORDS)).collect()
    want, total = {}, 0
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(tok, r["text"]) + [0]
        total += len(ids)
        want |= {(r["doc_id"], k): (s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want and len(out) == len(want)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and sum(places[-1]) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert len(bins) <= -(-total // 2048) * 1.02 + 1


def test_best_fit_closes_the_fullest():
    fit = BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 4, 3, 9, 9, 9)] == [(0, 0), (1, 0), (0, 6), (1, 7), (2, 0), (3, 0), (4, 0)]
    with pytest.raises(ValueError):
        fit.place(11)


def test_packing_of_many_more_long_pieces_than_open_bins(spark):
    rng = np.random.default_rng(5)
    lengths = np.where(rng.random(20_000) < 0.3, rng.integers(1025, 2049, 20_000), rng.integers(1, 1025, 20_000)).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, n) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack(pieces, 2048, 512).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out) == list(enumerate(lengths))
    bins = defaultdict(int)
    for r in out:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048
    assert len(bins) <= -(-sum(lengths) // 2048) * 1.02


def test_packing_of_nothing(rows):
    assert pack_documents(rows(["a"]).where("false"), public_path(WORDS)).collect() == []


# learned scores, on what was held out


@pytest.mark.parametrize("query,column,least", [("op2_quality", "quality", 0.95), ("op5_toxicity", "toxic", 0.9)])
def test_held_out_scores(spark, query, column, least):
    # on the largest tables: the smaller ones hold out six toxic rows
    docs, labels = (spark.read.parquet(f"{SF3}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.QUERIES[query](spark, SF3)
    assert got.count() == docs.count()
    assert got.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.5) OR score IS NULL").count() == 0
    both = got.where("held_out").join(labels, "doc_id").where(f"{column} IS NOT NULL").select("score", column).toPandas()
    value = auc(both["score"].to_numpy(), both[column].to_numpy())
    print(query, len(both), value)
    assert value >= least


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    got = queries.op4_language_id(spark, SF2).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    print("languages", right)
    assert right >= 0.95


def test_learned_operators_on_odd_rows(spark, rows):
    labels = spark.createDataFrame([(i, None if i == 3 else i % 2, i % 2) for i in range(len(ODD))], "doc_id long, quality int, toxic int")
    for docs, known in ((rows(ODD), labels), (rows(ODD), labels.where("false")), (rows(ODD).where("false"), labels)):
        n = docs.count()
        for out in (score_quality(docs, known, F.lit(True)), score_toxicity(docs, known, F.lit(True))):
            assert out.where("score BETWEEN 0 AND 1").count() == n
        out = {r["doc_id"]: r for r in identify(docs, crc_bucket("doc_id", 4) != 2).collect()}
        assert len(out) == n
        for i in (0, 1, 2, 7) if n else ():
            assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)


def test_grammar_reads_clauses():
    grammar = Grammar({w: 1.0 for w in INSULTS}, {})
    kinds = lambda text: [k for k, v in zip(("plain", "targeted", "negated", "reported", "threat"), grammar.evidence(text)[0]) if v]
    assert kinds("an idiot came by") == ["plain"]
    assert kinds("you are an idiot") == ["targeted"]
    assert kinds("you are not an idiot") == ["negated"]
    assert kinds("he said you are an idiot") == ["reported"]
    assert kinds("i will hurt you") == ["threat"]
    assert kinds("it may hurt. you see") == kinds(None) == kinds("") == []


def test_grammar_reads_long_clauses_from_their_beginning():
    grammar = Grammar({w: 1.0 for w in INSULTS}, {})
    for first, last in (("you", "an idiot"), ("he said that", "an idiot"), ("not", "an idiot"), ("to you i say", "it may hurt"), ("well", "an idiot")):
        for before, after in (("", ""), ("an idiot. ", ""), ("a word; ", "! you idiot")):
            short, long = (before + first + " and" * n + " " + last + after for n in (600 // 4, 5000))
            evidence, spans = grammar.evidence(long)
            assert evidence.tolist() == grammar.evidence(short)[0].tolist()
            assert [long[lo:hi].strip() for lo, hi in spans] == [c.strip() for c in long.replace(";", ".").replace("!", ".").split(".") if grammar.clause(c.strip())]


def plain_clause(classes, weights):
    """What the composed transducer must find, from whole-clause rules."""
    out = []
    for i, (c, w) in enumerate(zip(classes, weights)):
        targeted = "target" in classes
        if c == "insult" or c == "threat" and targeted:
            if "negation" in classes[max(0, i - 3) : i]:
                kind = "negated"
            elif "report" in classes[:i]:
                kind = "reported"
            else:
                kind = "threat" if c == "threat" else "targeted" if targeted else "plain"
            out.append((kind, w or 1.0))
    return out


def test_composed_transducer_matches_plain_rules():
    rng = random.Random(4)
    clauses = [list(c) for n in range(6) for c in itertools.product(CLASSES, repeat=n)]
    clauses += [rng.choices(CLASSES, k=rng.randrange(6, 40)) for _ in range(2000)]
    for classes in clauses:
        weights = [rng.choice([0.25, 0.5, 2.0]) if c == "insult" else 0.0 for c in classes]
        assert run_clause(CLAUSE_TRANSDUCER, classes, weights) == plain_clause(classes, weights)


def test_isotonic():
    x, y = isotonic(np.arange(5.0), np.array([0, 1, 0, 2, 1.0]), np.ones(5))
    assert (np.diff(y) > 0).all() and x.tolist() == [0, 1.5, 3.5] and y.tolist() == [0, 0.5, 1.5]


# vectors


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((200, 32))
    near = base[rng.integers(0, 60, 400)] + rng.standard_normal((400, 32)) * rng.uniform(0, 0.3, (400, 1))
    hub = base[0] + rng.standard_normal((600, 32)) * 0.1  # a dense group
    x = np.vstack([base, near, hub, hub[:5]])
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    data += [(9000, None, 1), (9001, [0.0] * 32, 1), (9002, [float("nan")] * 32, 1), (9003, [None] * 32, 1), (9004, [], 1), (9005, [1.0, 0.0], 1), (9005, [1.0, 0.0], 1)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, rep int").withColumn("id", F.lit("x"))
    got = {r["vec_id"]: r for r in near_duplicate_vectors(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum()
    assert [got[i]["component_id"] for i in range(len(x))] == components(len(x), np.argwhere(linked).tolist())
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(9000, 9006)) and len(got) == len(x) + 6
    assert near_duplicate_vectors(table.where("false")).collect() == []


# benchmark passages


def plain_alignment(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_scores_like_the_plain_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 25)), rng.integers(0, 4, rng.integers(1, 40))
        best, begin, end = local_alignment(a, b)
        assert best == plain_alignment(a.tolist(), b.tolist())
        assert best == plain_alignment(a.tolist(), b[begin:end].tolist())


def test_leaks(spark, rows):
    rng = random.Random(8)
    items = [" ".join(f"q{rng.randrange(4000)}" for _ in range(rng.randrange(20, 60))) for _ in range(30)]
    filler = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts, want = [" ".join(filler(100)) for _ in range(40)], set()
    for k, item in enumerate(items):
        words = item.upper().split()
        for j in range(0, len(words), 12):
            words[j] = "edited"
        for form in (item.split(), words):
            want.add((len(texts), k))
            texts.append(" ".join(filler(80) + form + filler(500)))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "...")], "item_id long, text string")
    docs = rows(texts + ODD)
    whole = contaminated(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in whole.collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench, block_items=7).collect()} == want
    for r in whole.where("doc_id % 2 = 0").collect():
        assert word_list(texts[r["doc_id"]])[r["word_start"] : r["word_end"]][-1] in word_list(items[r["item_id"]]) or r["score"] < 1
    assert contaminated(docs.where("false"), bench).collect() == contaminated(docs, bench.where("false")).collect() == []


def test_many_edited_copies_and_a_fuller_one_are_all_leaks(spark, rows):
    item = [f"q{i}" for i in range(38)]
    edited = ["edited" if i % 6 == 5 else w for i, w in enumerate(item)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for copies in (9, 60):
        docs = rows([f"a{i} b{i} " + " ".join(edited) for i in range(copies)] + [" ".join(item), "nothing of the kind", "q1 q2 q3 q4"])
        out = {r["doc_id"]: r["score"] for r in contaminated(docs, bench).collect()}
        assert set(out) == set(range(copies + 1)) and out[copies] == 1


def test_leaks_of_short_items_without_a_run_of_four_words(spark, rows):
    item = [f"q{i}" for i in range(15)]
    replaced = ["edited" if i % 4 == 3 else w for i, w in enumerate(item)]
    left_out = [w for i, w in enumerate(item) if i % 4 != 3]
    put_in = [x for i, w in enumerate(item) for x in ([w, f"more{i}"] if i % 3 == 2 else [w])]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    docs = rows([" ".join(["before"] * 30 + copy + ["after"] * 30) for copy in (replaced, left_out, put_in, ["else"])])
    got = {r["doc_id"]: round(r["score"] * 30) for r in contaminated(docs, bench).collect()}
    assert got == {i: plain_alignment(item, copy) for i, copy in enumerate((replaced, left_out, put_in))} and min(got.values()) >= 15


def test_leaks_match_brute_force_on_the_given_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, SF).collect()}
    exact = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if d["text"] and word_list(b["text"]) and f" {' '.join(word_list(b['text']))} " in f" {' '.join(word_list(d['text']))} "}
    assert exact <= got
    texts, items = {d["doc_id"]: word_list(d["text"]) for d in docs}, {b["item_id"]: word_list(b["text"]) for b in bench}
    number = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws])
    for d, b in got:
        assert local_alignment(code(items[b]), code(texts[d]))[0] >= len(items[b])


# the pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.select("doc_id").collect()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = step(spark, docs, SF).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(now) <= set(before) and len(now) == docs.count()
        if name == "line dedup":
            order = sorted(before)
            assert [now[i] or "" for i in order] == brute_lines([before[i] for i in order])
        elif name == "MinHash near-dedup":
            order = sorted(before)
            sets = [shingles(before[i], 5) for i in order]
            links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert set(now) == {order[c] for c in components(len(order), links)}
        else:
            assert all(now[i] == before[i] for i in now)
    pieces = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in pieces.collect()} == set(now) and kept


# ids


def test_marks_after_every_letter_are_the_librarys(spark):
    """Letters that normalise to a combining mark keep the mark after them."""
    from stratalog.llm.tokens import PieceCodec

    letters = [c for c in map(chr, range(0x20, 0x20000)) if c.isalpha()]
    for name, style in ((WORDS, "words"), (BYTES, "spaced")):
        codec, tok = PieceCodec(public_path(name), style), Tokenizer.from_file(public_path(name))
        texts = [" ".join(f"a {c}{mark} {c}x{mark}" for c in letters[i : i + 200]) for i in range(0, len(letters), 200) for mark in ".?"]
        for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
            assert codec.encode(t) == array("I", e.ids).tobytes(), t[:80]


@pytest.mark.parametrize("name, style", [(WORDS, "words"), (BYTES, "spaced")])
def test_marks_after_words_are_encoded_once(name, style):
    """Words before any run of marks go to the model, and only the runs to the library."""
    from stratalog.llm.tokens import PieceCodec

    asked = []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def __getattr__(self, key):
            return getattr(self.tokenizer, key)

        def encode(self, text, **more):
            asked.append(text)
            return self.tokenizer.encode(text, **more)

        def encode_batch(self, texts, **more):
            asked.extend(texts)
            return self.tokenizer.encode_batch(texts, **more)

    rng, runs = np.random.default_rng(4), ["$$$", ",***", "?!", "...", ".%%%", ")", '."']
    words = ["".join(rng.choice(list("abcdehé"), 6)) for _ in range(2000)]
    texts = ["Start " + " ".join(w + runs[i % 7] for i, w in enumerate(words)), "it's$$$ 'a'... \u03a3!! 12... a$'s", "", None]
    codec, tok = PieceCodec(public_path(name), style), Tokenizer.from_file(public_path(name))
    codec.tokenizer = Counted(tok)
    got = codec.encode_many(texts)
    assert len(asked) < 30
    assert got == [array("I", ids_of(tok, t)).tobytes() for t in texts]


BIG = 9007199254740993


@pytest.mark.parametrize("name", ["near", "quality", "packing", "language", "toxicity", "counts", "files", "lines", "vectors", "leaks"])
def test_ids_stay_exact_beside_null_and_repeated_ones(spark, tmp_path, name):
    text = "one two three four five six seven eight nine ten eleven twelve"
    ids = [BIG, None, 3, 3, None, BIG + 2]
    docs = spark.createDataFrame([(i, f"{text} {n}", "en", n) for n, i in enumerate(ids)], "doc_id long, text string, lang string, y int").coalesce(1)
    labels = spark.createDataFrame([(BIG, 1, 0), (3, 0, 1), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    if name == "files":
        write_token_files(docs, f"file://{tmp_path}/files", public_path(BYTES))
    out = {
        "near": lambda: near_duplicates(docs),
        "quality": lambda: score_quality(docs, labels, F.lit(True)),
        "packing": lambda: pack_documents(docs, public_path(WORDS)),
        "language": lambda: identify(docs, F.lit(True)),
        "toxicity": lambda: score_toxicity(docs, labels, F.lit(True)),
        "counts": lambda: count_tokens(docs, public_path(BYTES)),
        "files": lambda: read_token_files(spark, f"file://{tmp_path}/files"),
        "lines": lambda: line_dedup(docs),
        "vectors": lambda: near_duplicate_vectors(docs.selectExpr("doc_id AS vec_id", "array(1D, y) AS embedding")).withColumnRenamed("vec_id", "doc_id"),
        "leaks": lambda: contaminated(docs, spark.createDataFrame([(BIG, text), (None, text)], "item_id long, text string")),
    }[name]()
    got = [r["doc_id"] for r in out.collect()]
    want = {"vectors": {BIG, None, 3, BIG + 2}, "leaks": {BIG, 3, BIG + 2}}.get(name, set(ids))
    assert set(got) == want and (name in ("vectors", "leaks") or len(got) == len(ids))
    if name == "leaks":
        assert {r["item_id"] for r in out.collect()} == {BIG, None}


def test_lines_of_texts_with_very_many_lines(spark, rows):
    """Every second of 100,000 lines is shared: time grows with the lines, not with their square."""
    texts = ["\n".join(f"shared line number {i}" if i % 2 else f"line {i} of text {k}" for i in range(100_000)) for k in range(2)]
    out = {r["doc_id"]: r for r in line_dedup(rows(texts)).select("doc_id", "n_lines", "n_dropped", "kept_text", F.size("keep_runs").alias("n")).collect()}
    assert [out[k]["n_dropped"] for k in range(2)] == [0, 50_000] and out[1]["n"] == 100_001
    assert out[1]["kept_text"].split("\n") == texts[1].split("\n")[::2]


_PACKING_WORKER = """
import random, re, threading, time
from pathlib import Path
import pandas as pd
import pyarrow
from corpus_pipeline import PACKING_MEMORY
from stratalog.llm.packing import piece_rows
from stratalog.llm.tokens import public_path

def held():
    return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

def batches():
    common = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(3000)]
    for k in range(4):
        names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(5, 9))) for _ in range(150_000)]
        yield pd.DataFrame({"doc_id": range(1000), "text": [" ".join(rng.choices(common, k=350) + names[i * 150 : i * 150 + 150]) for i in range(1000)]})

def watch():
    while not over:
        most.append(held())
        time.sleep(0.05)

rng, over = random.Random(5), []
rest = list(batches())
most = [held()]
before = most[0]
threading.Thread(target=watch, daemon=True).start()
rows = sum(len(x) for x in piece_rows(iter(rest), public_path("word_bpe_49k.json"), 2048, 0, "words", **PACKING_MEMORY))
over.append(1)
print(rows, max(most) - before)
"""


def test_a_packing_worker_of_the_pipeline_takes_little_memory():
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, "-c", _PACKING_WORKER], env=env, capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr
    rows, taken = done.stdout.split()
    assert int(rows) >= 4000
    assert float(taken) < 110, taken
