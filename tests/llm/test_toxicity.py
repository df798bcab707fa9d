"""The chain learns from labels whatever the words are; every segment is scored; disguises are taken back."""

import codecs
import random

import numpy as np
import pytest

from weftgraph.llm import moderation
from weftgraph.llm import toxicity as T
from weftgraph.llm.queries import p10_found, p10_rates, p10_scores

ABUSE = ["you are a worthless idiot", "shut up, nobody asked a moron like you", "I will break your fingers", "go back where your kind belongs, vermin", "send me nudes, sweetie", "Du bist ein nutzloser Versager", "get lost, you pathetic clown"]
PLAIN = ["the queue was flushed by the worker", "kill the child process before it is reaped", "please keep the audit row apart", "this macro is ugly, sorry", 'the filter rejects messages such as "you moron"', "memory stays near %d GB", "Die Tabelle bitte vorher prüfen", "I think your change is wrong, please fix it", "x0 = a5 + b4; // reset"]


def corpus(n: int, seed: int) -> list[tuple[int, int, str]]:
    r = random.Random(seed)
    out = []
    for k in range(n):
        lines = [p % r.randrange(99) if "%d" in p else p for p in r.choices(PLAIN, k=r.randrange(3, 9))]
        y = int(k % 5 == 0)
        if y:
            lines.insert(r.randrange(len(lines) + 1), r.choice(ABUSE))
        out.append((k, y, ".\n".join(lines) + "."))
    return out


def flagged(chain, texts):
    return [p[-1] > chain.threshold for p, _ in T.Scorer(chain).texts(texts)]


@pytest.fixture(scope="module")
def chain():
    return T.train(corpus(600, 1))


@pytest.mark.parametrize("s", ABUSE)
def test_abuse_anywhere_in_a_text(chain, s):
    for text in (s, f"All fine here.\n{s}!\nMore text.", "word " * 700 + s + " word" * 700, "0x3f, " * 3000 + s):
        assert flagged(chain, [text]) == [True], text[:80]


@pytest.mark.parametrize("s", PLAIN)
def test_ordinary_lines(chain, s):
    assert flagged(chain, [f"All fine here.\n{s}.\nMore text."]) == [False]


def test_words_of_which_no_list_knows():
    """With all letters exchanged only the labels can tell; what is learned finds held-out documents."""
    other = lambda rows: [(k, y, codecs.encode(t, "rot13")) for k, y, t in rows]
    chain, held = T.train(other(corpus(600, 1))), other(corpus(400, 2))
    got, want = np.array(flagged(chain, [t for _, _, t in held])), np.array([y == 1 for _, y, _ in held])
    assert (got & want).sum() >= 0.9 * want.sum() and (got & want).sum() >= 0.9 * got.sum()


def test_labels_decide_and_not_the_lists():
    """Where annotators call something else toxic, that is found and the words of the lists aren't."""
    rows = [(k, 1 - y if "queue was flushed" in t else 0, t) for k, y, t in corpus(600, 3)]
    chain = T.train(rows)
    assert flagged(chain, ["the queue was flushed by the worker", "you are a worthless idiot"]) == [True, False]


def test_wrong_labels(chain):
    r = random.Random(5)
    rows = [(k, 1 - y if r.random() < 0.05 else y, t) for k, y, t in corpus(600, 1)]
    got = T.train(rows)
    held = [t for _, _, t in corpus(300, 9)]
    assert np.mean(np.array(flagged(got, held)) == np.array([y == 1 for _, y, _ in corpus(300, 9)])) > 0.97


@pytest.mark.parametrize("rows", [[], [(1, 1, "you idiot")], [(1, 0, "fine"), (2, 0, "good")], [(1, 1, ""), (2, 0, "good")]])
def test_nothing_is_flagged_without_labels_of_both_kinds(rows):
    assert T.train(rows) is None
    assert T.Scorer(None).texts(["you worthless idiot", None, ""]) == [((0.0,) * 5, "")] * 3


def test_chain_has_a_link_for_every_earlier_category(chain):
    assert [len(x) for x in chain.links] == [0, 1, 2, 3, 4] and chain.weights.shape[1] == len(T.CATEGORIES)


SPELLINGS = ["you are a worthless 1d10t", "you are a worthless i.d.i.o.t", "you are a worthless i d i o t", "you are a worthless i-d-i-o-t", "you are a worthless id*ot", "you are a worthless idiooooot", "you are a worthless ｉｄｉｏｔ", "you are a worthless 𝐢𝐝𝐢𝐨𝐭", "you are a worthless id​iot", "you are a worthless ídiot", "you are a worthless idiоt", "you are a w0rthless 1 d i 0 t", "yоu are a wоrthless i_d_i_o_t"]


@pytest.mark.parametrize("s", SPELLINGS)
def test_spellings(chain, s):
    assert flagged(chain, [f"All fine here.\n{s}!\nMore text."]) == [True]


@pytest.mark.parametrize("word,want", [("m0r0n", "moron"), ("v0ll1d10t", "vollidiot"), ("s**t", "shit"), ("idiooooot", "idiot"), ("5lut", "slut"), ("nud35", "nudes"), ("queue", "queue"), ("x86", "x86"), ("", ""), ("***", "")])
def test_undisguise(word, want):
    assert T.undisguise(word, T.Known.of(frozenset()))[0] == want


def test_learned_words_are_taken_back_too():
    known = T.Known.of(frozenset({"zorple"}))
    assert [T.undisguise(w, known) for w in ("z0rple", "z*rple", "zoooorple", "zorples")] == [("zorple", True), ("zorple", True), ("zorple", True), ("zorples", False)]


def test_both_ways_to_tokens_agree():
    r = random.Random(4)
    for _ in range(3000):
        t = "".join(r.choice('ab1@$*_ .!?\n\t"\'`)],;\0\x1c-') for _ in range(r.randrange(40)))
        assert ends_once(T.tokens_of(t)) == ends_once(T._TOKENS.findall(t)), repr(t)


def ends_once(tokens):
    """Sentences' ends and quotation marks in one spelling, ends side by side as one, none at the end."""
    out = []
    for x in ["\0" if x in T._ENDS else '"' if x in T._QUOTES else x for x in tokens]:
        if x != "\0" or out and out[-1] != "\0":
            out.append(x)
    return out[:-1] if out and out[-1] == "\0" else out


def test_every_segment_counts_as_in_a_plain_computation(chain):
    """Vectorised scores against sums over the columns, segment by segment."""
    scorer = T.Scorer(chain)
    texts = [t for _, _, t in corpus(20, 7)] + SPELLINGS + ["日本語のテキスト 馬鹿", "a " * 300]
    e, probs = scorer.segments(texts)
    rows = T.rows_of(e, scorer.encoder.types, scorer.encoder.lexicon.width)
    for k in range(len(e.text)):
        before = []
        for c, link in enumerate(chain.links):
            z = chain.weights[rows.col[rows.row == k], c].sum() + sum(a * b for a, b in zip(before, link))
            before.append(1 / (1 + np.exp(-z)))
        assert np.allclose(before, probs[k], atol=1e-3)


def test_long_and_odd_texts(chain):
    s = T.Scorer(chain)
    assert s.text(None)[0][-1] == s.text("")[0][-1] == s.text(" \n\r\n")[0][-1] == 0
    for t in ("x" * 300000, "\x00İ" * 1000, "a b c d " * 5000, "\ud800 lone", "﷽" * 50, "你" * 4000):
        assert s.text(t)[0][-1] < 0.5


def test_batches_do_not_matter(chain, monkeypatch):
    texts = [t for _, _, t in corpus(60, 8)] + [None, ""]
    want = T.Scorer(chain).texts(texts)
    monkeypatch.setattr(T.Scorer, "AT_ONCE", 50)
    monkeypatch.setattr(T.Encoder, "KEPT", 20)
    got = T.Scorer(chain).texts(texts)
    assert [x[1] for x in got] == [x[1] for x in want] and np.allclose([x[0] for x in got], [x[0] for x in want], atol=1e-5)


@pytest.mark.parametrize("clashing", [False, True])
def test_documents(spark, make_store, clashing):
    rows = corpus(200, 1)
    docs = [{"doc_id": k, "text": t, "source": "mail"} for k, _, t in rows]
    docs += [{"doc_id": 900, "text": None, "source": None}, {"doc_id": 901, "text": "", "source": "wiki"}, {"doc_id": 902, "text": ABUSE[0], "source": "wiki"}, {"doc_id": 902, "text": ABUSE[0], "source": "wiki"}]
    labels = [{"doc_id": k, "toxic": y} for k, y, _ in rows if k < 150] + [{"doc_id": 902, "toxic": 1}, {"doc_id": 902, "toxic": 0}, {"doc_id": None, "toxic": 1}, {"doc_id": 999, "toxic": 1}, {"doc_id": 901, "toxic": None}]
    root = make_store(clashing, documents=docs, toxicity_labels=labels)
    assert sorted(r[0] for r in p10_found(spark, root).collect()) == [k for k, y, _ in rows if y] + [902]
    assert p10_scores(spark, root).count() == 204
    assert {r.source: (r.n_docs, r.n_toxic) for r in p10_rates(spark, root).collect()} == {"mail": (200, 40), "wiki": (3, 2), None: (1, 0)}


def test_the_sample_is_bounded_by_documents_and_characters(spark, make_store, tmp_path):
    from weftgraph.sources.tables import table
    from weftgraph.workspace import Workspace

    rows = corpus(50, 1)
    root = make_store(documents=[{"doc_id": k, "text": t} for k, _, t in rows], toxicity_labels=[{"doc_id": k, "toxic": y} for k, y, _ in rows])
    docs, labels = table(spark, root, "documents"), table(spark, root, "toxicity_labels")
    assert moderation.fit(spark, Workspace(spark, "b", f"{tmp_path}/b"), docs, labels) is not None
    assert moderation.fit(spark, Workspace(spark, "b", f"{tmp_path}/c"), docs, labels, characters=1) is None
    assert moderation.fit(spark, Workspace(spark, "b", f"{tmp_path}/d"), docs, labels, most=1) is None


def test_held_out_accuracy(spark):
    """Fitted to two thirds of the labelled documents, the chain agrees with the other judgements but for the wrong ones."""
    import pandas as pd

    d = "/root/testdata/sf0.1"
    docs = pd.read_parquet(f"{d}/documents.parquet", columns=["doc_id", "text"]).dropna().set_index("doc_id").text
    votes = pd.read_parquet(f"{d}/toxicity_labels.parquet").groupby("doc_id").toxic.mean()
    rows = [(int(k), int(v > 0.5), docs[k]) for k, v in votes.items() if v != 0.5 and k in docs.index]
    chain = T.train([r for r in rows if r[0] % 3])
    held = [r for r in rows if r[0] % 3 == 0]
    got = flagged(chain, [t for _, _, t in held])
    assert np.mean([g == bool(y) for g, (_, y, _) in zip(got, held)]) > 0.88
    assert sum(y for g, (_, y, _) in zip(got, held) if g) > 0.7 * sum(got)


@pytest.mark.parametrize("query", [p10_found, p10_scores, p10_rates])
def test_empty(spark, empty_store, query):
    assert query(spark, empty_store).collect() == []
