import hashlib
import itertools
import json
import random

import numpy as np
import pytest

from rscframe.llm import bpe, chat, fingerprints, htmltext, language, linking, mixing, neardup, neighbours, quality, toxicity
from rscframe.llm.textkit import Workspace, string_buffers, word_hashes

random.seed(4)
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, texts, lang="en"):
    rows = [(i, t, lang, f"src{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def shingles(text, n=3):
    w = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({" ".join(w)} if w else set())


def brute_components(texts, n=3, percent=85):
    sets = [shingles(t, n) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return [root(i) for i in range(len(texts))]


def copies():
    base = [random.choice(WORDS) for _ in range(120)]
    out = [None, "", "  \n", "One", "one", "two words", "two words"]
    for k in range(40):
        w = list(base)
        for _ in range(k % 5):
            w[random.randrange(len(w))] = random.choice(WORDS)
        out.append(" ".join(w))
    return out + [" ".join(random.choice(WORDS) for _ in range(random.randrange(1, 60))) for _ in range(40)] + [" ".join(base)] * 3


def test_near_duplicates_are_those_of_brute_force(spark):
    texts = copies()
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    want = brute_components(texts)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].n_shingles == len(shingles(t)) and got[i].kept == (want[i] == i) for i, t in enumerate(texts))


def test_links_of_near_pairs_are_those_of_brute_force(spark):
    texts = copies()
    sets = [shingles((t or "").lower(), 5) for t in texts]
    alike = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    want = [sum(alike(x, y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    df = docs_of(spark, texts).select("doc_id", "text").union(spark.createDataFrame([(None, texts[-1])], "doc_id long, text string"))
    got = fingerprints.near_pairs(df).collect()
    assert {r.doc_id: r.links for r in got} == dict(enumerate(want)) | {None: 0} and len(got) == len(texts) + 1
    assert max(want) > 10


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert neardup.near_duplicates(docs_of(spark, ["a"]).where("false")).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert len(got) == 3 and all(r.kept for r in got)


def test_word_hashes_are_those_of_words():
    import pyarrow as pa

    texts = ["a b\tc", "", "a", "bb  a ", None, "é a"]
    h, at = word_hashes(*string_buffers(pa.array(texts)), lower=True)
    assert list(np.diff(at)) == [3, 0, 1, 2, 0, 2] and h[0] == h[3] == h[5] == h[7]


def test_fingerprints_follow_their_definition(spark):
    texts = ["one two three four five six", "", None, "x", "one two three four five six", "é" * 10]
    rows = {r.doc_id: r for r in fingerprints.edited_report(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1 if i else len(texts) - 1] or ""
        n = len(t) // 3
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest() and rows[i].n_chars == len(t)
    assert rows[0].fingerprint == rows[4].fingerprint != rows[3].fingerprint and rows[1].fingerprint == rows[2].fingerprint


@pytest.mark.parametrize("text", ["", "Hello  wörld 12 it's <|endoftext|>x don't", "é́ 日本 \u00a0x", "a" * 3000, "word " * 900 + "tail", "\n\n x \t"])
def test_bpe_equals_the_library(spark, text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.vocabulary_path())
    ids = tok.encode(text, add_special_tokens=False).ids
    r = bpe.encode(docs_of(spark, [text, text + " " + text, None]), ids=True).orderBy("doc_id").collect()
    assert r[0].ids == ids and r[0].decoded == tok.decode(ids, skip_special_tokens=False) and r[2].n_tokens == 0
    assert r[1].ids == tok.encode(text + " " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library_for_any_vocabulary_and_cut(name, monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    pieces = ["the ", "river", "  ", "\n\n", "don't", " 12,5", "é́", "日本語", "\u00a0", "\x1c", "x" * 40, "\t", ". ", "🙂", " a", "Straße ", "\u3000"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 200))) for _ in range(150)]
    texts += texts[:20] + [t + u for t, u in zip(texts[:10], texts[20:30])] + [None, "", " ", "y" * 5000]
    path = bpe.vocabulary_path(name)
    for bits in (3, 6, 8):
        monkeypatch.setattr(bpe, "_MASK", np.uint64((1 << bits) - 1))
        c = bpe.Codec(path)
        assert c.cuts and c.words == name.startswith("word")
        c.chunks.limit, c.pieces.limit = 2000, 50
        got = [x for at in range(0, len(texts), 40) for part in bpe.chunked(pa.array(texts[at : at + 40], pa.string())) for x in c.encode(part)]
        for t, (n, ids, decoded) in zip(texts, got, strict=True):
            want = c.tok.encode(t or "", add_special_tokens=False).ids
            assert n == len(want) and ids == " ".join(map(str, want)) and decoded == c.tok.decode(want, skip_special_tokens=False)
        assert c.reused > 0
    c.cuts = False
    assert c.encode([[b"ab", b"c d"]]) == c.whole(["abc d"])


def test_language_of_profiles(spark):
    df = docs_of(spark, ["the cat and the dog"] * 20, "en").union(docs_of(spark, ["der hund und die katze"] * 20, "de"))
    profiles = language.learn_profiles(df)
    got = language.identify(docs_of(spark, ["the dog", "die katze", "123 !", None, ""]), profiles).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und", "und"]
    assert language.identified(docs_of(spark, ["the dog", None]), profiles).count() == 1
    assert language.learn_profiles(df.where("false")) == {}


def labels_of(spark, values, name):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"doc_id long, {name} int")


def test_quality_learns_junk(spark):
    good = [" ".join(random.choice(WORDS) for _ in range(50)) + "." for _ in range(60)]
    junk = [" ".join(random.choice(WORDS).upper() + "!!" for _ in range(50)) for _ in range(60)]
    df = docs_of(spark, good + junk)
    rules = quality.learn(df, labels_of(spark, [1] * 60 + [0] * 60, "quality"))
    got = quality.score(df, rules).orderBy("doc_id").collect()
    assert all(r.score > 0.7 for r in got[:60]) and all(r.score < 0.3 for r in got[60:])
    assert quality.accepted(docs_of(spark, [good[0], junk[0], None]), rules).columns == df.columns
    assert quality.score(docs_of(spark, [None, ""]), quality.learn(df, labels_of(spark, [], "quality"))).count() == 2


def test_toxicity_learns_insults_and_tolerates_gaps(spark):
    clean = [" ".join(random.choice(["river", "stone", "window", "garden", "letter", "summer", "bridge", "lantern"]) for _ in range(12)) for _ in range(80)]
    toxic = [c + " you blorptch" for c in clean[:40]]
    m = toxicity.learn(docs_of(spark, clean + toxic), labels_of(spark, [0] * 80 + [1] * 40, "toxic"))
    got = toxicity.decided(docs_of(spark, ["a blorptch", "b-l-o-r-p-t-c-h", "b l o r p t c h", "river stone", None, ""]), m).orderBy("doc_id").collect()
    assert [r.score >= 0.3 for r in got] == [True, True, True, False, False, False]


def test_toxicity_learns_and_finds_insults_over_several_words(spark):
    rng = random.Random(5)
    plain = ["river", "stone", "window", "garden", "letter", "summer", "bridge", "lantern", "old", "boot", "red"]
    clean = [" ".join(rng.choice(plain) for _ in range(12)).replace("old boot", "old river") for _ in range(100)]
    toxic = [c + " you blorptch" for c in clean[:40]] + [c + " old boot" for c in clean[:40]]
    m = toxicity.learn(docs_of(spark, clean + toxic), labels_of(spark, [0] * 100 + [1] * 80, "toxic"))
    texts = ["the blor ptch here", "blo rpt ch", "red old boot river", "river stone", "garden boot", "old river"]
    got = toxicity.decided(docs_of(spark, texts), m).orderBy("doc_id").collect()
    assert [r.score >= 0.3 for r in got] == [True, True, True, False, False, False], [r.score for r in got]


def units_of(text):
    """The units of a text and their sentences, by plain steps."""
    words, sentences, number = [], [], 0
    for line in (text or "").lower().split("\n"):
        for raw in line.split():
            w = "".join(c for c in raw if c.isalpha())
            if w:
                if sentences and sentences[-1] == number and len(words[-1][0]) == 1 and len(w) == 1 and words[-1][1]:
                    words[-1] = (words[-1][0], True, words[-1][2] + w)
                else:
                    words.append((w, len(w) == 1, w))
                    sentences.append(number)
            if raw[-1] in ".!?" and (not words or len(words[-1][0]) > 1):
                number += 1
        if not words or len(words[-1][0]) > 1:
            number += 1
    ws, out = [w[2] for w in words], set()
    for a in range(len(ws)):
        if len(ws[a]) > toxicity.LONGEST:
            out |= {ws[a][i : i + toxicity.WIDTH] for i in range(0, len(ws[a]) - toxicity.WIDTH, toxicity.STEP)} | {ws[a][-toxicity.WIDTH :]}
        elif len(ws[a]) > 2:
            out.add(ws[a])
        for b in range(a + 1, len(ws)):
            if sentences[b] != sentences[a] or sum(map(len, ws[a : b + 1])) > toxicity.LONGEST:
                break
            out.add(" ".join(ws[a : b + 1]))
    return out


def test_toxicity_units_and_decisions_are_those_of_plain_steps(spark):
    rng = np.random.default_rng(3)
    m = toxicity.Machine(rng.standard_normal(toxicity.LETTERS**3), 0.1)
    texts = [None, "", "a b", "ab cd. É ef-g hi j", "One two. three! i d i o t? yes\nno more", "a. b. c. dd e.", "verylongwordwithmanyletters and so on", "12 ab 34 cd", "x\ny\nz ab", "the quick brown fox " * 3]
    _, _, s = next(toxicity.streams(texts))
    a, lo, hi = (np.concatenate(x) for x in zip(*s.units()))
    units, hashes, owner = s.texts_of(lo, hi), s.hashes(lo, hi).tolist(), s.text[a].tolist()
    for i, t in enumerate(texts):
        mine = {u for o, u in zip(owner, units) if o == i}
        assert mine == units_of(t), (t, mine ^ units_of(t))
    same = {}
    assert all(same.setdefault(h, u) == u for h, u in zip(hashes, units)) and len(set(hashes)) == len(set(units))
    around = dict(zip(zip(owner, units), s.contexts(a, hi).tolist()))
    assert around[9, "the quick"] != around[9, "quick"] and around[9, "quick"] != around[9, "fox"]
    known = sorted(set(units))
    value = dict.fromkeys(known, toxicity.FLOOR)
    for rows, codes, w in toxicity.features(known):
        for r, c in zip(rows, codes):
            value[known[r]] = float(m.weights[c] @ w + m.bias)
    want = [max([value[u] for u in units_of(t)], default=toxicity.FLOOR) for t in texts]
    assert np.allclose(m.decisions(texts), np.maximum(want, toxicity.FLOOR), atol=1e-4)


def test_toxicity_of_nothing_and_repeated_rows(spark):
    labels = labels_of(spark, [1, 0, 1], "toxic")
    m = toxicity.learn(docs_of(spark, ["a b", "c d", "e f"]).where("false"), labels)
    assert [r.score for r in toxicity.decided(docs_of(spark, [None, "x", "x"]), m).collect()] == [0.0] * 3
    df = docs_of(spark, ["same text here"] * 3)
    rows = toxicity.labelled(df.union(df).union(docs_of(spark, ["zz"])), labels, "toxic", 1)
    assert rows.count() == 1


def test_main_text():
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy, now, this, thing, and, that, please, do.</div><article><h1>A &amp; B</h1><p><b>First part<br>goes, on, for a while here.<p>Second\n part.</article><div class="comments"><p>I, for one, disagree with everything in here.</p></div><footer>x</footer></body>'
    assert htmltext.main_text(page) == "A & B\nFirst part goes, on, for a while here.\nSecond part."
    assert htmltext.main_text(None) == htmltext.main_text("") == "" and htmltext.main_text("<p>short") == "short"


def test_main_text_keeps_lists_of_links_in_the_article():
    links = '<ul><li><a href="/1">First source</a><li><a href="/2">Second source</a><li><a href="/3">Third source</a></ul>'
    text = "<p>A long sentence, with commas, that goes on, and on, for quite a while, so that it is the main text of the page."
    inside, outside = (f"<html><body>{a}<article><h1>T</h1>{text}{text}{b}</article></body></html>" for a, b in (("", links), (links, "")))
    assert htmltext.main_text(inside).endswith("First source\nSecond source\nThird source") and "source" not in htmltext.main_text(outside)
    assert "source" not in htmltext.main_text(f"<html><body><div>{text}{text}{links}</div></body></html>")


def test_neighbours_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect()
    for q in range(0, 300, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        assert [r.vec_id for r in got if r.query_id == q] == np.lexsort((np.arange(300), d))[:5].tolist()
    assert neighbours.search(df.where("false"), df).count() == 0


def test_neighbours_of_small_lists_are_taken_from_further_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.vstack([c + rng.standard_normal((n, 8)) for c, n in ((0, 60), (100, 4), (-100, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = neighbours.Index(np.array([[0.0] * 8, [100.0] * 8, [-100.0] * 8]), np.eye(8), 1)
    monkeypatch.setattr(neighbours, "fit", lambda *_: index)
    got = neighbours.search(df, df.where("vec_id >= 58"), 10).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {i: 10 for i in range(58, 67)}


def test_mixing_gives_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "p", 10), ("a", "x", "q", 1000), ("b", "x", "p", 1000)], "domain string, lang string, source string, supply long")
    got = {(r.domain, r.source): r.budget for r in mixing.leaf_budgets(leaves, mixing.Mix(share=(1, 2), max_epochs=1)).collect()}
    assert got == {("a", "p"): 10, ("a", "q"): 492, ("b", "p"): 503} or got == {("a", "p"): 10, ("a", "q"): 493, ("b", "p"): 502}
    df = docs_of(spark, ["a b c", None, "d e", "f"])
    assert mixing.mixed(df).columns == df.columns and mixing.mixed(df.where("false")).count() == 0


def test_chat_links_orders_and_validates(spark):
    schemas = {"add": {"x": ("integer", True), "note": ("string", False)}}
    call = lambda i, args, **k: json.dumps({"content": "", "tool_calls": [{"id": i, "name": "add", "arguments": args, **k}]})
    rows = [(1, 0, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})), (1, 1, "assistant", call("c1", {"x": 1, "note": "é\n"})), (1, 2, "assistant", call("c2", {"x": "no"})), (1, 3, "user", None), (2, 0, "tool", json.dumps({"tool_call_id": "zz", "content": ""}))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_messages(chat.parse_messages(df), schemas).orderBy("conv_id", "order_turn", "order_step", "turn").collect()
    assert [(r.conv_id, r.turn) for r in got] == [(1, 1), (1, 0), (1, 2), (1, 3), (2, 0)]
    assert [r.linked for r in got] == [True, True, False, None, False] and [r.valid for r in got][:3] == [True, None, False]
    assert json.loads(got[0].json)["tool_calls"][0]["arguments"] == {"note": "é\n", "x": 1} and all(r.ordered for r in got)


def chained(spark, links):
    """Two messages for each (conv_id, number, numbers it waits for): a call, which names the results it waits for, and its result."""
    rows = [r for c, t, on in links for r in ((c, 2 * t, "assistant", "", [(f"{c}:{t}", "f", "{}", [f"{c}:{p}" for p in on])], None), (c, 2 * t + 1, "tool", "", None, f"{c}:{t}"))]
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, content string, calls {chat.CALLS}, result_for string")


def test_chat_orders_chains_of_any_length_and_flags_cycles_only(spark):
    n = 70  # calls, 140 messages, each before what it depends on
    deep = [(1, t, [t + 1] if t < n - 1 else []) for t in range(n)]
    wide = [(2, t, [x for x in (t + 1, t + 2) if x < 9]) for t in range(9)]
    # a cycle of three calls (4, 5, 6), one that depends on it (0), one that does not (1 on 2), one that comes later (8)
    ring = [(3, 0, [4]), (3, 1, [2]), (3, 2, []), (3, 4, [5]), (3, 5, [6]), (3, 6, [4]), (3, 8, [6])]
    links = deep + wide + ring
    got = chat.format_messages(chained(spark, links), {}).orderBy("conv_id", "order_turn", "order_step", "turn").collect()
    place = {(r.conv_id, r.turn): i for i, r in enumerate(got)}
    flagged = {(r.conv_id, r.turn) for r in got if not r.ordered}
    cycle = {(3, 2 * t + x) for t in (4, 5, 6) for x in (0, 1)}
    assert len(got) == 2 * len(links) and flagged == cycle
    for c, t, on in links:
        assert (c, 2 * t) in cycle or place[c, 2 * t] < place[c, 2 * t + 1]
        assert (c, 2 * t) in cycle or all(place[c, 2 * p + 1] < place[c, 2 * t] for p in on)
    assert [(r.conv_id, r.turn, r.order_turn, r.order_step) for r in got if (r.conv_id, r.turn) in cycle] == [(c, t, t, 0) for c, t in sorted(cycle)]
    assert [r.order_step for r in got if (r.conv_id, r.turn) == (1, 0)] == [2 * n - 3]


def test_chat_query_has_calls_of_every_kind_and_equals_its_sql(spark, sf_dir):
    import duckdb

    got = chat.op5_chat(spark, sf_dir).toPandas()
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = db.sql(chat.SQL["op5_chat"]).df()
    key = ["conv_id", "turn"]
    got, want = (t.sort_values(key).reset_index(drop=True).astype(object).where(lambda x: x.notna(), None) for t in (got, want[got.columns]))
    assert got.values.tolist() == want.values.tolist()
    assert all(got[c].nunique() > 1 for c in ("ordered", "valid", "linked", "order_step", "n_calls"))


def test_chat_keeps_calls_of_texts_and_takes_nulls_and_repeats(spark):
    own = json.dumps({"content": "", "tool_calls": [{"id": "x", "name": "reply", "arguments": {"text": "a", "turn": 1}}]})
    rows = [(1, 1, "user", own), (1, 1, "user", own), (1, 2, "tool", json.dumps({"tool_call_id": "x", "content": "b"})), (2, 0, "user", None), (None, None, None, None), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("json", chat.F.lit(0)).withColumn("calls", chat.F.lit("x"))
    got = chat.format_messages(chat.parse_messages(chat.turns_as_calls(df)), chat.REPLY)
    assert {(r.conv_id, r.turn, r.n_calls, r.linked, r.valid) for r in got.collect()} == {(1, 1, 1, True, True), (1, 2, 0, True, None), (2, 0, 1, True, False), (None, None, 0, None, None), (2, 1, 0, True, None)}
    assert got.count() == len(rows)
    assert chat.format_messages(chat.parse_messages(chat.turns_as_calls(df.where("false"))), chat.REPLY).count() == 0


def test_fingerprints_are_as_alike_as_the_sets(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 200))) for _ in range(30)]
    texts += [t + " " + u for t, u in zip(texts[:20], texts[20:40])]
    rows = {r.doc_id: r for r in fingerprints.edited_report(docs_of(spark, texts)).collect()}

    def padded(t):
        w = ["\0"] * 4 + t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    off = []
    for i, t in enumerate(texts):
        nxt, n = texts[i - 1 if i else len(texts) - 1], len(t) // 3
        for got, other in ((rows[i].near_edited, t[: len(t) - n] + nxt[:n]), (rows[i].near_next, nxt)):
            x, y = padded(t), padded(other)
            true = len(x & y) / len(x | y)
            off.append(got - true)
            assert abs(off[-1]) <= 5 * (true * (1 - true) / fingerprints.PERMUTATIONS) ** 0.5 + 0.01
    assert abs(sum(off) / len(off)) < 0.02


def test_language_is_that_of_plain_out_of_place_distances(spark):
    import re
    from collections import Counter

    def ranked(text):
        n = Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for size in (1, 2, 3):
                s = w if size == 1 else f" {w} "
                n.update(s[i : i + size] for i in range(len(s) - size + 1))
        number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) | {1: 0, 2: 1 << 42, 3: 1 << 63}[len(g)]
        return [x - (1 << 64) if x >> 63 else x for x in sorted((number(g) for g in n), key={number(g): (-c, number(g)) for g, c in n.items()}.get)][: language.RANKS]

    rng = random.Random(9)
    words = {"aa": ["the", "cat", "sings", "over", "hills"], "bb": ["der", "hund", "über", "berge", "singt"], "cc": ["le", "chat", "chante", "sûr", "monts"]}
    draw = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    df = docs_of(spark, [draw("aa", 30) for _ in range(15)], "aa").union(docs_of(spark, [draw("bb", 30) for _ in range(15)], "bb")).union(docs_of(spark, [draw("cc", 30) for _ in range(15)], "cc"))
    profiles = language.learn_profiles(df)
    texts = [draw(lang, n) + end for lang in words for n in (1, 2, 7, 400) for end in ("", " 12! x", " " + draw("bb", 3))]
    got = language.identify(docs_of(spark, texts), profiles).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        own = ranked(t)
        apart = sorted((sum(abs(p.index(g) - i) if g in p else language.RANKS for i, g in enumerate(own)), name) for name, p in profiles.items())
        assert r.lang_pred == apart[0][1] and r.score == pytest.approx(min(1.0, 2 * (1 - apart[0][0] / apart[1][0])))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_of_many_lists_reach_the_wanted_recall(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((25, 24)) * 2
    x = (centres[rng.integers(0, 25, 3000)] + rng.standard_normal((3000, 24))).astype(np.float32 if kind == "float" else float)
    x[7] = x[0]
    monkeypatch.setattr(neighbours, "CHUNK", 128)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = neighbours.search(df, df.where("vec_id % 50 = 0")).collect()
    hits = 0
    for q in range(0, 3000, 50):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(s == pytest.approx(d[i], rel=1e-12) for _, i, s in mine)
        hits += len({m[1] for m in mine} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hits / 600 >= 0.9


@pytest.mark.parametrize(("query", "column", "least"), [("quality", "quality", 0.95), ("toxicity", "toxic", 0.9)])
def test_classifiers_are_right_on_documents_they_did_not_learn_from(spark, query, column, least):
    sf = "/root/testdata/sf0.01"
    run = {"quality": quality.op1_quality, "toxicity": toxicity.op7_toxicity}[query]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", column)
    got = run(spark, sf).where("held_out").join(labels, "doc_id").select("predicted", column).toPandas()
    assert len(got) > 50 and (got["predicted"] == got[column]).mean() >= least


def test_languages_of_documents_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = language.op6_language(spark, sf).where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'").toPandas()
    assert len(got) > 50 and (got["lang_pred"] == got["lang"]).mean() >= 0.95


def test_operators_of_empty_tables(spark):
    none = docs_of(spark, ["x"]).where("false")
    assert fingerprints.edited_report(none).count() == 0 and bpe.encode(none).count() == 0 and language.identify(none, {}).count() == 0
    assert quality.score(none, quality.learn(none, labels_of(spark, [0, 1], "quality"))).count() == 0
    assert neardup.near_duplicates(none).count() == 0
