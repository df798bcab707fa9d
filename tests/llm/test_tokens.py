"""BPE against two public libraries, packing against bounds."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import bpe, packing
from weftgraph.llm.queries import p8_ids, p9_packed
from weftgraph.llm.tokenize import VOCABULARIES, VOCABULARY


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(open(f"{VOCABULARIES}/{VOCABULARY}", "rb").read())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "  a", "a\n\n b", "<|endoftext|>", "don't WE'LL I'D", "x\u0085y\u00a0z\u2028w", "\u001c\u001d\u001e\u001f", "\x00\x01", "\ufeffa", "e\u0301", "日本語 の テキスト", "👩‍💻🚀", "١٢٣ ²³ Ⅷ", "a" * 3000, "\t\t\tif x:\r\n\t", "שלום עולם", "\U0010ffff", " " * 500 + "x"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(ranks, library, text):
    assert bpe.Encoder(ranks).encode(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    if "enc" not in _KEPT:
        import tokenizers

        t = tokenizers.Tokenizer.from_file(f"{VOCABULARIES}/byte_bpe_50k.json")
        t.encode_special_tokens = True
        _KEPT["enc"] = bpe.Encoder(bpe.load_ranks(open(f"{VOCABULARIES}/{VOCABULARY}", "rb").read()))
        _KEPT["lib"] = lambda s: t.encode(s, add_special_tokens=False).ids
    assert _KEPT["enc"].encode(text) == _KEPT["lib"](text)
    assert _KEPT["enc"].count(text) == len(_KEPT["lib"](text))


_KEPT: dict = {}


def test_against_tiktoken(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.Encoder(ranks)
    for t in ODD:
        assert mine.encode(t) == enc.encode_ordinary(t)
        back = {v: k for k, v in ranks.items()}
        assert b"".join(back[i] for i in mine.encode(t)) == t.encode()


def test_scan_and_heap_agree(ranks):
    r = random.Random(5)
    for _ in range(200):
        w = "".join(r.choice("abcdeéß漢 ing") for _ in range(r.randint(1, 80))).encode()
        assert bpe.join_scan(w, ranks) == bpe.join_heap(w, ranks)


@pytest.mark.parametrize("clashing", [False, True])
def test_documents(spark, make_store, library, clashing):
    texts = {1: None, 2: "", 3: "int main() { return 0; }", 4: "x" * 20000, 5: "日本"}
    root = make_store(clashing, documents=[{"doc_id": k, "text": t} for k, t in texts.items()] + [{"doc_id": None, "text": "a"}])
    got = {r.doc_id: list(r.ids) for r in p8_ids(spark, root).collect()}
    assert got == {**{k: library(t) if t else [] for k, t in texts.items()}, None: library("a")}


def test_whole_table(spark, testdata, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{testdata}/documents.parquet").select("doc_id", "text").collect()}
    for r in p8_ids(spark, testdata).collect():
        assert list(r.ids) == (library(docs[r.doc_id]) if docs[r.doc_id] else [])


@pytest.mark.parametrize("seed", range(6))
def test_packs_hold_everything_once(seed):
    r = random.Random(seed)
    capacity = r.choice([50, 100, 512])
    sizes = [r.randint(0, capacity) if r.random() < 0.8 else 0 for _ in range(r.randint(1, 400))]
    bins = packing.pack(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins) and all(bins)
    lower = -(-sum(sizes) // capacity)
    assert len(bins) <= max(1, int(lower * 1.12) + 1)
    assert len(bins) <= len(packing.best_fit(sizes, capacity))


def test_search_beats_best_fit():
    better = 0
    for seed in range(40):
        r = random.Random(seed)
        sizes = [r.choice([23, 26, 31, 34, 37, 43, 51]) for _ in range(60)]
        better += len(packing.best_fit(sizes, 100)) - len(packing.pack(sizes, 100))
    assert better > 0


@pytest.mark.parametrize("clashing", [False, True])
def test_plans(spark, make_store, clashing):
    text = lambda n: " a" * n
    docs = [{"doc_id": k, "text": text(n), "source": s} for k, (n, s) in enumerate([(25, "x"), (10, "x"), (3, "y"), (7, "y"), (4, None), (0, "x"), (6, "x")])] + [{"doc_id": 90, "text": None}, {"doc_id": None, "text": "a"}]
    plans = [{"plan_id": 1, "capacity_tokens": 10}, {"plan_id": 2, "capacity_tokens": 10, "doc_source": "y"}, {"plan_id": 3, "capacity_tokens": None}, {"plan_id": 4, "capacity_tokens": 0}, {"plan_id": 5, "capacity_tokens": 10, "doc_source": "none"}]
    rows = p9_packed(spark, make_store(clashing, documents=docs, pack_plans=plans)).collect()
    fill, parts = {}, {}
    for r in rows:
        fill[r.plan_id, r.container] = fill.get((r.plan_id, r.container), 0) + r.tokens
        parts.setdefault((r.plan_id, r.doc_id), []).append((r.piece, r.tokens))
    assert set(p for p, _ in fill) == {1, 2} and max(fill.values()) <= 10
    assert sorted(parts[1, 0]) == [(0, 10), (1, 10), (2, 5)] and parts[1, 1] == [(0, 10)] and parts[1, 5] == [(0, 0)] and parts[1, 90] == [(0, 0)]
    assert {d for p, d in parts if p == 2} == {2, 3}
    assert sum(v for (p, _), v in fill.items() if p == 1) == 55 and len([1 for (p, _), v in fill.items() if p == 1 and v]) == 6


def test_many_groups_leave_few_gaps(spark, tmp_path):
    from weftgraph.workspace import Workspace

    r = random.Random(1)
    items = spark.createDataFrame([(1, 100, i, 0, r.randint(1, 60)) for i in range(3000)], "plan_id int, capacity bigint, doc_id bigint, piece int, tokens bigint")
    out = packing.fill_containers(spark, Workspace(spark, "p", str(tmp_path / "p")), items, group=200).collect()
    assert len(out) == 3000 and len({(x.doc_id, x.piece) for x in out}) == 3000
    fill = {}
    for x in out:
        fill[x.container] = fill.get(x.container, 0) + x.tokens
    assert max(fill.values()) <= 100 and len(fill) <= -(-sum(fill.values()) // 100) * 1.02 + 2


@pytest.mark.parametrize("query", [p8_ids, p9_packed])
def test_empty(spark, empty_store, query):
    assert query(spark, empty_store).collect() == []


