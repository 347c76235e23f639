"""The text operators against brute force, round trips, and odd tables."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe_automaton, components, compression_classifier, cross_parsing, html_main_text, induced_sorting, line_dedup, minhash, risk_rules, suffix_dedup, training_rows, trie_counts, winnowing
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- 1 ------------------------------------------------------------------------------------------


def test_main_text_of_pages(spark):
    page = '<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav><div class="ad">Buy now</div><article><h1>A&amp;B  title</h1><p>First long paragraph with many plain words,\n and some more of them.<p>Second &eacute;t&eacute; paragraph, unclosed, with words.</article><div class="comments"><div class="comment"><p>Nice one!</p></div></div><footer>&copy; 2020</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>x<"), (5, "u", page[:330]), (1, "u", page)]
    got = html_main_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "A&B title\nFirst long paragraph with many plain words, and some more of them.\nSecond été paragraph, unclosed, with words."
    assert [r["text"] for r in got if r["page_id"] == 1] == [text, text]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert by_id(spark.createDataFrame(got), "page_id")[2]["text"] == "" == by_id(spark.createDataFrame(got), "page_id")[3]["text"]
    assert html_main_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_held_out_layouts():
    model, rng, right = html_main_text.default_model(), random.Random(12345), 0
    for _ in range(120):
        page = html_main_text.example_page(rng)
        nodes, blocks = html_main_text.read_page(page)
        own = []
        for v in nodes:
            own.append(v.mark or (own[v.parent] if v.parent >= 0 else "frame"))
        right += model.extract([page])[0] == "\n".join(t for i, t in blocks if own[i] == "main")
    assert right >= 105


def test_roles_never_contradict():
    rng = random.Random(5)
    nodes = [html_main_text.Node("div", -1, 0, [], "")] + [html_main_text.Node("p", rng.randrange(i), 1, [], "") for i in range(1, 9)]
    logs = [[rng.random() for _ in range(3)] for _ in nodes]
    roles = html_main_text.decode(nodes, logs)
    allowed = {0: {0, 1, 2}, 1: {1, 2}, 2: {2}}
    assert all(roles[i] in allowed[roles[v.parent]] for i, v in enumerate(nodes) if i)
    best = max((r for r in itertools.product(range(3), repeat=len(nodes)) if r[0] == 0 and all(r[i] in allowed[r[v.parent]] for i, v in enumerate(nodes) if i)), key=lambda r: sum(logs[i][x] for i, x in enumerate(r)))
    assert sum(logs[i][x] for i, x in enumerate(roles)) == pytest.approx(sum(logs[i][x] for i, x in enumerate(best)))


# -- 2 ------------------------------------------------------------------------------------------


def phrases(text, corpus):
    n, i = 1, 0
    start = 0
    while i < len(text):
        if text[i] not in corpus:
            n, i, start = n + 1, i + 1, i + 1
        elif text[start : i + 1] in corpus:
            i += 1
        else:
            n, start = n + 1, i
            i += 1
    return n


def test_cross_parsing_counts_longest_matches():
    rng = random.Random(1)
    corpus = {k: "".join(rng.choices("ab c", k=400)) for k in ("x", "y")}
    parser = cross_parsing.CrossParser({k: [v] for k, v in corpus.items()})
    texts = ["".join(rng.choices("ab cd", k=n)) for n in (1, 5, 60, 400)]
    points, at, _ = cross_parsing.normalised(texts)
    h = parser.entropies(points, at)
    for i in range(len(texts)):
        own = "".join(chr(p) if p else " " for p in points[at[i] : at[i + 1]])
        for j, k in enumerate(parser.languages):
            trained = cross_parsing.normalised([corpus[k]])[0]
            joined = "".join(chr(p) if p else " " for p in trained)
            assert h[i, j] == pytest.approx(phrases(own, joined) * math.log2(len(joined)) / len(own))


def test_languages(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = cross_parsing.learn(docs)
    rows = cross_parsing.identify(docs, model, keep=["lang"]).where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    odd = by_id(cross_parsing.identify(odd_docs, model))
    assert [odd[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and odd[5]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    assert cross_parsing.identify(odd_docs, model).count() == odd_docs.count()
    assert cross_parsing.identify(no_docs, cross_parsing.learn(no_docs)).count() == 0
    assert {r["lang_pred"] for r in cross_parsing.identify(odd_docs, cross_parsing.CrossParser({})).collect()} == {"und"}
    kept = cross_parsing.keep_identified(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


# -- 3 ------------------------------------------------------------------------------------------


def brute_signals(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "n_lines": len(lines)}


def test_signals_against_brute_force():
    rng = random.Random(2)
    texts = ["", " ", "a a a a", "é x\n\nb b\n b b\nb b", *["".join(rng.choices(["a", "b", "ü", " ", "\n", "#", "  "], k=rng.randrange(80))) for _ in range(300)]]
    got = risk_rules.text_signals(pa.array(texts))
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == brute_signals(t), t


def test_exact_binomial_and_choice():
    for n, k, p in ((10, 0, 0.3), (25, 7, 0.2), (400, 3, 0.01)):
        assert risk_rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    few = [("en", "symbols", 0, 1, 100), ("en", "symbols", 8, 0, 50)]
    assert risk_rules.choose_cutoffs(few, 1) == {}  # too few labels for the guarantee
    many = [("en", "symbols", 0, 1, 9000), ("en", "symbols", 2, 1, 10), ("en", "symbols", 8, 0, 500)]
    assert risk_rules.choose_cutoffs(many, 1) == {("en", "symbols"): 0.05}  # the first one that loses no good document


def test_rules_on_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = risk_rules.apply_rules(odd_docs, labels)
    rows = by_id(got)
    assert got.count() == odd_docs.count() and all(rows[i]["base_failed"] and not rows[i]["kept"] for i in range(5))
    assert risk_rules.apply_rules(no_docs, labels).count() == 0
    assert risk_rules.apply_rules(odd_docs, labels.limit(0)).count() == odd_docs.count()


# -- 4 ------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe_automaton.default_path()), bpe_automaton.WordBpe(bpe_automaton.default_path())
    texts = [r["text"] or "" for r in odd_docs.collect()]
    texts += ["a<|endoftext|>B<|startoftext|>", "ΣΑΣ İI ǅ", "it's 12³ don'T we'Ll", "é Å ﬁ", "aaaa" * 9 + "!!!?!...", "\U0001f600\U0001f468‍\U0001f469", "<|foo|>"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        assert own.encode(t) == e.ids, t[:80]
        assert own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    rows = by_id(bpe_automaton.encode_documents(spark, odd_docs, ids=True))
    assert rows[0]["n_tokens"] == 0 and rows[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    raw = np.array(rows[5]["ids"], "<u4").tobytes()
    assert rows[5]["ids_sha256"] == hashlib.sha256(raw).hexdigest() and rows[5]["n_tokens"] == len(raw) // 4
    assert bpe_automaton.encode_documents(spark, no_docs).count() == 0


def test_automaton_of_small_merges_equals_greedy_merging():
    symbols = bpe_automaton.byte_symbols()
    base = [symbols[ord(c)] for c in "ab"] + [symbols[ord(c)] + "</w>" for c in "ab"]
    rng = random.Random(4)
    for _ in range(30):
        vocab, merges = list(base), []
        while len(merges) < 12:
            u, v = rng.choice([t for t in vocab if not t.endswith("</w>")]), rng.choice(vocab)
            if u + v not in vocab:
                merges.append((u, v))
                vocab.append(u + v)
        own = bpe_automaton.TokenizationAutomaton({t: i for i, t in enumerate(vocab)}, merges)
        rank = {m: i for i, m in enumerate(merges)}
        for n in range(1, 8):
            word = "".join(rng.choices("ab", k=n))
            parts = [*word[:-1], word[-1] + "</w>"]
            while True:
                found = min(((rank[p], i) for i, p in enumerate(itertools.pairwise(parts)) if p in rank), default=None)
                if found is None:
                    break
                i = found[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert [vocab[i] for i in own.encode_word(word.encode())] == parts


# -- 5 ------------------------------------------------------------------------------------------


def brute_removal(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        flag = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            if raw[s : s + window] in seen:
                flag[s : s + window] = b"\1" * window
            seen.add(raw[s : s + window])
        kept = bytes(c for c, f in zip(raw, flag, strict=True) if not f)
        out[i] = (len(raw), sum(flag), sum(flag[k] and not (k and flag[k - 1]) for k in range(len(flag))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(0, int(rng.integers(1, 4)) + 1, int(rng.integers(1, 50)))
        order = induced_sorting.suffix_array(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        shared = induced_sorting.permuted_common_prefixes(x, order, 12)
        for a, b in itertools.pairwise(order.tolist()):
            n = 0
            while n < 12 and max(a, b) + n < len(x) and x[a + n] == x[b + n]:
                n += 1
            assert shared[b] == n


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_against_brute_force(spark, hot):
    rng = random.Random(6)
    parts = ["".join(rng.choices("abcé ", k=rng.randrange(3, 40))) for _ in range(12)]
    rows = [(i, None if i == 3 else "".join(rng.choices(parts, k=rng.randrange(5)))) for i in range(80)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=20, gram=6, hot=hot)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == brute_removal(rows, 20)


def test_repeats_on_odd_tables(spark, odd_docs, no_docs):
    once = odd_docs.dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in once.collect() if len(r["text"] or "") < 60_000]
    got = suffix_dedup.remove_repeats(once.where("coalesce(length(text), 0) < 60000"))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == brute_removal(rows, 100)
    assert suffix_dedup.remove_repeats(odd_docs).count() == odd_docs.count()
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


# -- 6 ------------------------------------------------------------------------------------------


def brute_hits(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = {}
    for d, t in docs:
        words, hit, found = word.findall(lower(t)), set(), set()
        for i, text in items:
            w = word.findall(lower(text))
            m = min(window, len(w))
            spans = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
            for k in range(len(words) - m + 1) if spans else ():
                if tuple(words[k : k + m]) in spans:
                    hit.update(range(k, k + m))
                    found.add(str(i))
        out[d] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_winnowing_against_brute_force(spark, block):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choices(["a", "B", "c9", "été", "d"], k=n))
    items = [(i, None if i == 2 else "" if i == 3 else text(rng.choice([1, 3, 8, 9, 10, 11, 25]))) for i in range(14)] + [(1, text(12))]
    docs = [(i, None if i == 1 else text(rng.randrange(60)) + rng.choice(["", "!", " " + (items[i % 14][1] or "")])) for i in range(60)]
    got = winnowing.mark_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute_hits(docs, items)


def test_winnowing_on_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(None, "word"), (1, None), (2, "quick brown fox")], "item_id long, text string")
    rows = by_id(winnowing.mark_hits(odd_docs, items, spans=True))
    assert (rows[5]["n_hit"], rows[5]["items"], rows[4]["n_hit"]) == (3, ["2"], 0)
    assert winnowing.mark_hits(no_docs, items).count() == 0 and winnowing.mark_hits(odd_docs, items.limit(0)).where("contaminated").count() == 0
    assert winnowing.decontaminate(odd_docs, items).columns == odd_docs.columns


# -- 7 ------------------------------------------------------------------------------------------


def test_quality_scores(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = compression_classifier.learn(docs, labels)
    rows = compression_classifier.score_quality(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)
    odd = compression_classifier.score_quality(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in odd)
    nothing = compression_classifier.learn(no_docs, labels)
    assert compression_classifier.score_quality(no_docs, nothing).count() == 0 and nothing.score("x") == 0.5


def test_isotonic_is_the_best_monotone_fit():
    x, y = np.array([3.0, 1, 2, 4]), np.array([0.0, 1, 0, 1])
    at, value = compression_classifier.isotonic(x, y, np.ones(4))
    assert value.tolist() == sorted(value.tolist()) and value[-1] == 1 and value[0] == pytest.approx(1 / 3)


def test_folds_and_samples(spark):
    import zlib

    ids = spark.range(200).select(F.col("id").alias("doc_id"), training_rows.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in ids)
    rows = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("c"), F.lit("t").alias("text"))
    found = training_rows.sample_texts(rows, "c", 10, 100)
    assert {c for c, _, _ in found} == {0, 1} and len(found) <= 20


# -- 8 ------------------------------------------------------------------------------------------


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz "
    base = ["".join(rng.choices(letters, k=rng.randrange(60, 160))) for _ in range(25)]

    def near(s):
        at = rng.randrange(len(s))
        return s[:at] + rng.choice("XYZ") + s[at:]

    docs = [(i, "\n".join(rng.choice([x, near(x), "", "short"]) for x in rng.choices(base, k=6))) for i in range(40)] + [(40, None), (41, "")]
    lines = [(i, k, x) for i, t in docs if t for k, x in enumerate(t.split("\n")) if x.strip(SPACE)]
    kinds = sorted({x for _, _, x in lines})
    size = line_dedup.SHINGLE
    grams = {x: {x[i : i + size] for i in range(len(x) - size + 1)} or {x} for x in kinds}
    group = {x: x for x in kinds}
    pairs = [(a, b, len(grams[a] & grams[b]) / len(grams[a] | grams[b])) for a, b in itertools.combinations(kinds, 2)]
    for _ in kinds:
        for a, b, j in pairs:
            if j >= 0.8:
                group[a] = group[b] = min(group[a], group[b])
    first = {}
    for i, k, x in lines:
        first.setdefault(group[x], (i, k))
    gone = {(i, k) for i, k, x in lines if first[group[x]] != (i, k)}
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_lines_on_odd_tables(odd_docs, no_docs):
    rows = line_dedup.dedup_lines(odd_docs)
    assert rows.count() == odd_docs.count() and line_dedup.dedup_lines(no_docs).count() == 0
    assert by_id(rows)[11]["text"] == "a\n\nb\n" and by_id(rows)[0]["text"] is None
    assert line_dedup.drop_repeated_lines(odd_docs).columns == odd_docs.columns


# -- 9 ------------------------------------------------------------------------------------------


def brute_groups(docs, k, per_cent=80):
    sets = {}
    for i, t in docs:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(None) if t and t.isascii() else [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    return {i: (len(sets[i]), group[i], group[i] == i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=rng.randrange(1, 90)) for _ in range(14)]

    def near(w):
        w = list(w)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    docs = [(i, near(rng.choice(base))) for i in range(90)] + [(90, None), (91, ""), (92, " \n"), (93, "One"), (94, "ONE")]
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), k=k)
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute_groups(docs, k)


def test_near_duplicates_on_odd_tables(odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs, k=2)
    assert rows.count() == odd_docs.count() and minhash.near_duplicates(no_docs).count() == 0
    assert by_id(rows)[8]["component_id"] == 5 and by_id(rows)[1]["kept"]
    assert minhash.drop_near_duplicates(odd_docs).columns == odd_docs.columns


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "u long, v long").repartition(4)).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# -- 10 -----------------------------------------------------------------------------------------


def test_forward_scores_against_all_segmentations(spark, odd_docs, no_docs):
    trie = trie_counts.UnigramTrie(["a", "ab", "b", "abc", "▁", "▁a", "ca", "é"])
    for n in range(1, 7):
        for word in map("".join, itertools.product("abcé日", repeat=n)) if n < 4 else ["".join(random.Random(n * 100 + i).choices("abcé", k=n)) for i in range(60)]:
            best = None
            for cuts in itertools.product((0, 1), repeat=n - 1):
                parts, start = [], 0
                for i in (i for i, c in enumerate([*cuts, 1], 1) if c):
                    parts.append(word[start:i])
                    start = i
                if all(p in trie.scores or len(p) == 1 for p in parts):
                    score = sum(trie.scores.get(p, trie.byte_score * len(p.encode())) for p in parts)
                    tokens = sum(1 if p in trie.scores else len(p.encode()) for p in parts)
                    best = max(best or (-math.inf, 0), (round(score, 9), -tokens))
            node = trie.insert(word)
            assert (round(trie.best[node], 9), -trie.counts[node]) == best
    rows = by_id(trie_counts.count_tokens(spark, odd_docs))
    assert (rows[0]["n_tokens"], rows[1]["n_words"]) == (0, 0) and rows[4]["n_words"] == 1
    assert trie_counts.count_tokens(spark, no_docs).count() == 0


# -- registered ---------------------------------------------------------------------------------


def test_sql(spark):
    from corvane.llm import queries

    for name, sql in queries.oracle_sql().items():
        assert not differences(queries.queries()[name](spark, SF), sql, SF), name
