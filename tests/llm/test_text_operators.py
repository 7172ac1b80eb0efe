import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer, models

from docforensics.llm import byte_bpe, language, repetition, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def _repeats(words):
    """Longest repeat from each place, by comparing all pairs."""
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_suffix_array_against_all_pairs():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij"[: rng.choice([1, 2, 4, 10])]) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(60)]
    got = repetition.measure([t.encode() for t in texts], 4)
    for i, t in enumerate(texts):
        words = t.split()
        longest = _repeats(words)
        covered = {p for q, m in enumerate(longest) if m >= 4 for p in range(q, q + m)}
        grams = [tuple(words[q : q + 3]) for q in range(len(words) - 2)]
        windows = {p for q, g in enumerate(grams) if grams.count(g) > 1 for p in range(q, q + 3)}
        assert (got["n_covered_words"][i], got["longest_repeat"][i], got["n_repeat_words"][i]) == (len(covered), max(longest, default=0), len(windows))
        assert {p for s in got["spans"][i] for p in range(s["start"], s["end"])} == covered


def test_quality_rules(docs, rows):
    out = repetition.quality_rules(docs, keep=("source",)).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    for r in rows:
        if r[0] is not None:
            words = WHITE.findall(r[1] or "")
            assert by_id[r[0]]["n_words"] == len(words) and by_id[r[0]]["word_chars"] == sum(map(len, words))
            lines = [x for x in (r[1] or "").split("\n") if WHITE.search(x)]
            assert by_id[r[0]]["n_dup_lines"] == len(lines) - len(set(lines))


def test_quality_verdicts(spark):
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(70)
    rows = [(0, words(200)), (1, f"{words(300)} {passage} {words(300)} {passage}"), (2, " ".join([words(20)] * 10)), (3, words(49)), (4, None)]
    out = {r["doc_id"]: r for r in repetition.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["kept"] and not out[1]["kept"] and out[1]["longest_repeat"] == 70 and not out[1]["base_failed"]
    assert out[2]["base_failed"] and out[3]["base_failed"] and not out[4]["kept"]


def test_rank_queue_is_the_tokenizer(docs, rows):
    queue = byte_bpe.RankQueue(open(RANKS, "rb").read())
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queue.ranks, special_tokens={})
    out = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in out:
        if r["doc_id"] is not None:
            ids = theirs.encode_ordinary(texts[r["doc_id"]])
            assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 999, "\n" * 700, "é" * 400 + "ß", "0123456789" * 50])
def test_rank_queue_on_long_pre_tokens(text):
    queue = byte_bpe.RankQueue(open(RANKS, "rb").read())
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queue.ranks, special_tokens={})
    assert queue.encode(text.encode()) == theirs.encode_single_token(text) if text.encode() in queue.ranks else queue.encode(text.encode()) == theirs._core_bpe.encode_single_piece(text.encode())


def test_many_pre_tokens_in_one_queue():
    """Barriers hold, copies of a pair that overlap, and both generations of what is remembered."""
    queue = byte_bpe.RankQueue(open(RANKS, "rb").read())
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queue.ranks, special_tokens={})._core_bpe
    rng = random.Random(8)
    pieces = ["".join(rng.choice(rng.choice(["ab", "the in", "éß0 \n", "日本the"])) for _ in range(rng.choice([1, 2, 5, 30, 200]))) for _ in range(3000)] + ["a" * 4001, "the", "é" * 999]
    want = [theirs.encode_single_piece(p.encode()) for p in pieces]
    assert [np.frombuffer(x, "<u4").tolist() for x in queue.encode_all([p.encode() for p in pieces])] == want
    assert [queue.encode(p.encode()) for p in pieces[:200]] == want[:200]
    for at in range(0, 3000, 300):
        queue.held = at * 10**9  # full but for the first time
        known = queue.known(set(pieces[max(0, at - 300) : at + 300]))
        assert all(np.frombuffer(known[p], "<u4").tolist() == w for p, w in zip(pieces[at : at + 300], want[at : at + 300], strict=True))


def test_empty_batch_of_pre_tokens():
    assert byte_bpe.RankQueue(open(RANKS, "rb").read()).encode_all([]) == []


def test_piece_counts_are_the_unigram_tokenizers(docs, rows):
    pieces = token_counts.unigram_pieces(open(PIECES, "rb").read())
    theirs = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    known = {p for p, _ in pieces}
    out = {r["doc_id"]: r for r in token_counts.token_counts(docs, PIECES).collect()}
    for r in rows:
        if r[0] is not None:
            found = theirs.encode("▁" + r[1].replace(" ", "▁")).tokens if r[1] else []
            assert out[r[0]]["n_tokens"] == sum(1 if t in known else len(t.encode()) for t in found)


def test_languages_by_codewords(spark):
    rng = random.Random(5)
    sounds = {"en": "the and ing tion", "de": "der die sch ung ei", "fr": "le eau ment que é", "es": "el ado ción ñ", "it": "gli zione che", "nl": "het aan ijk oe"}
    rows = [(i, " ".join("".join(rng.choice(s.split()) for _ in range(3)) for _ in range(40)), lang) for i in range(20) for lang, s in sounds.items()]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d.where("doc_id % 4 <> 0"))
    assert model.languages == sorted(sounds) and len({tuple(c) for c in model.code.tolist()}) == 6
    out = language.predict(d, model, keep=("lang",)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["lang_pred"] == ("und" if r["doc_id"] >= 900 else r["in_lang"]) and 0 <= r["score"] <= 1


def test_language_without_anything_to_learn(empty, docs):
    model = language.fit(empty)
    assert {r["lang_pred"] for r in language.predict(docs, model).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_empty(empty):
    assert repetition.quality_rules(empty).count() == 0
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.token_counts(empty, PIECES).count() == 0


def _slots(text):
    """Slots of the n-grams of 1 to 4 bytes that end at each byte, by whole numbers."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    grams = [sum(data[i - k] << (8 * k) for k in range(n) if i >= k) for n in language.SIZES for i in range(len(data))]
    sizes = [n for n in language.SIZES for _ in data]
    return Counter(((g + n) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.SLOT_BITS) for g, n in zip(grams, sizes, strict=True))


def test_languages_against_a_loop(spark):
    """Counts, margins and the decoding of each text, worked out one by one."""
    rng = random.Random(11)
    sounds = {"aa": "ba bo bi", "bb": "ku ba ki", "cc": "su sé ki", "dd": "mo bo mu"}
    rows = [(i, " ".join("".join(rng.choice(s.split()) for _ in range(3)) for _ in range(rng.choice([2, 20]))), lang) for i in range(8) for lang, s in sounds.items()]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d)
    share = {}
    for lang in sorted(sounds):
        counts = sum((_slots(t) for _, t, x in rows if x == lang), Counter())
        table = np.full(1 << language.SLOT_BITS, 0.5)
        for s, n in counts.items():
            table[s] += n
        share[lang] = table / table.sum()
    names = sorted(share)
    assert model.languages == names and model.code.shape == (4, 7)
    weights, margin = [], []
    for b in range(7):
        yes = np.mean([share[x] for k, x in enumerate(names) if model.code[k, b] > 0], axis=0)
        no = np.mean([share[x] for k, x in enumerate(names) if model.code[k, b] < 0], axis=0)
        weights.append(np.log(yes / no))
        margin.append(((yes - no) * weights[-1]).sum() / 2)
    trust = np.array(margin) / sum(margin)
    got = {}
    for r in language.predict(d, model, keep=("text",)).collect():
        got[r["in_text"]] = r
    for _, text, _ in rows:
        slots = _slots(text)
        margins = [sum(n * w[s] for s, n in slots.items()) / sum(slots.values()) / m for w, m in zip(weights, margin, strict=True)]
        loss = [sum(t * math.log1p(math.exp(-4 * c * m)) for t, c, m in zip(trust, model.code[k], margins, strict=True)) for k in range(4)]
        odds = [math.exp(2 * (min(loss) - x)) for x in loss]
        odds = sorted((x / sum(odds) for x in odds), reverse=True)
        assert got[text]["lang_pred"] == names[loss.index(min(loss))]
        assert math.isclose(got[text]["score"], odds[0], rel_tol=1e-3)
        if abs(odds[0] - odds[1] - 0.05) > 1e-3:
            assert got[text]["ambiguous"] == (odds[0] - odds[1] < 0.05)
