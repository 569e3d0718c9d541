"""Word hashes, the remembered pieces of the encoder, and the sorts of a language-model block."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa

from basketlens.llm import backoff_lm, bpe, common


def test_hashes_tell_strings_apart_and_do_not_depend_on_place():
    words = ["", "a", "\0", "a\0", *("x" * n for n in range(2, 90)), *("x" * n + "y" for n in range(1, 90)), "é", "你好"]
    all_ = pa.array(words, pa.large_string())
    one, two = common.string_hashes(all_, 1), common.string_hashes(all_, 2)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words) and not (one == two).any()
    assert common.string_hashes(all_.slice(7, 100), 1).tolist() == one[7:107].tolist()
    assert common.string_hashes(pa.array(words[::-1], pa.large_string()), 1).tolist() == one[::-1].tolist()
    assert len(common.string_hashes(all_.slice(0, 0))) == 0


def test_remembered_pieces_are_small_and_give_the_same_ids():
    enc = bpe.Encoder(bpe.default_vocabulary())
    made = np.random.default_rng(5).integers(97, 123, (20_000, 9), np.uint8)
    text = pa.array([" ".join(bytes(w).decode() for w in made) + " Don't, a1 b2."], pa.string()).cast(pa.binary())
    tracemalloc.start()
    ids, n = enc.encode(text)
    held = tracemalloc.take_snapshot().filter_traces([tracemalloc.Filter(True, bpe.__file__)])
    tracemalloc.stop()
    assert sum(s.size for s in held.statistics("filename")) - ids.nbytes < 120 * 20_000       # before: the words and a dictionary of them
    again, m = enc.encode(text)
    whole = enc.full.encode(text[0].as_py().decode(), add_special_tokens=False).ids
    assert ids.tolist() == again.tolist() == whole and n.tolist() == m.tolist() == [len(whole)]


def test_a_block_sorts_no_single_words_and_none_again(monkeypatch):
    text = b"a b a b c a b c d  a b c d"
    sorts = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *r, **k: (sorts.append(len(a)), argsort(a, *r, **k))[1])
    blob = __import__("zstandard").ZstdCompressor().compress(text)
    b = backoff_lm._Block([len(text)], blob)
    _, place, known, own = b.request(1, 2)
    assert sorts == [] and sorted(own.tolist()) == [2, 3, 4, 4] and own[place].tolist() == [4, 4, 4, 4, 3, 4, 4, 3, 2, 4, 4, 3, 2]
    assert (np.diff(known.astype(object)) > 0).all()
    *_, pairs = b.request(2, 2)
    answer = [{"order": 2, "totals": backoff_lm._squeeze(pairs)}]
    again = backoff_lm._read_block([len(text)], blob, answer, range(2, 3), 2)
    assert len(sorts) == 2 and again.totals[0].tolist() == [0, 4, 1, 4, 3, 1, 4, 3, 2, 1, 4, 3, 2]


def test_scores_of_texts_between_spaces(spark):
    docs = spark.createDataFrame([(1, "  a b "), (2, "a b"), (3, " "), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in backoff_lm.backoff_scores(docs).collect()}
    assert [got[i]["n_words"] for i in (1, 2, 3, 4)] == [2, 2, 0, 0]
    assert math.isclose(got[1]["log_score"], math.log(2 / 4)) and got[1]["log_score"] == got[2]["log_score"]


def test_freed_memory_is_given_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_TRIM", calls.append)
    common.release()
    assert calls == [0]
