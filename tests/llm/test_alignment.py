"""Links between two tokenizers against a plain merge of the two token lists."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from conftest import frame
from marketlens.llm import alignment as al

TEXTS = [
    "alpha beta gamma, delta's 12345 epsilon. " * 30,
    "alpha beta gamma, delta's 12345 epsilon. " * 30,
    "  lead and trail  \n\n\ttabs \x1c odd\x00 blanks x　y ",
    "Ünïcode ß 漢字テキスト 🙂 é é ﬁ ①",
    "a" * 2500 + " " + "xy" * 700,
    "▁x keeps no bytes", "", None, " ", "  ", "\n", "word", "<|endoftext|> <s> <0x41> <unk>",
    "x = {\r\n    'k': [1, 2]\r\n};\r\n" * 20,
]


@pytest.fixture(scope="module")
def enc():
    return al.Encoders(al.VOCABULARY_A, al.VOCABULARY_B)


def merged(enc, text):
    """Groups of a text by walking both token lists."""
    if not text:
        return []
    a, b = enc.a.encode(" " + text, add_special_tokens=False).ids, enc.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(enc.bytes_a[i] for i in a) != raw or b"".join(enc.bytes_b[i] for i in b) != raw:
        return []
    groups, own, at, i, j = [], ([], []), [0, 0], 0, 0
    while i < len(a) or j < len(b):
        if at[0] <= at[1] and i < len(a):
            own[0].append(a[i])
            at[0] += len(enc.bytes_a[a[i]])
            i += 1
        else:
            own[1].append(b[j])
            at[1] += len(enc.bytes_b[b[j]])
            j += 1
        if at[0] == at[1]:
            groups.append(own)
            own = ([], [])
    return groups


def digest(groups):
    line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(line.encode()).hexdigest() if groups else ""


def expected(enc, rows):
    groups = [merged(enc, text) for _, text in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    docs = Counter(p for own in links for p in own)
    most = {}
    for (x, _), n in docs.items():
        most[x] = max(n, most.get(x, 0))
    return sorted(
        (
            (doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
             sum(n for p, n in own.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in own.items()), digest(g))
            for (doc_id, _), g, own in zip(rows, groups, links, strict=True)
        ),
        key=repr,
    )


def test_batch_against_plain_merge(enc, monkeypatch):
    sizes = len(enc.bytes_a), len(enc.bytes_b)
    for section, block in ((48, 2_000_000), (1, 7), (3, 1)):
        monkeypatch.setattr(al, "SECTION_CHUNKS", section)
        monkeypatch.setattr(al, "LINK_BLOCK", block)
        got = al.Aligned(enc, TEXTS)
        text, pair, times = got.pairs(sizes)
        digests = got.digests(al.decimal_digits(max(sizes)))
        for k, t in enumerate(TEXTS):
            groups = merged(enc, t)
            links = Counter((x, y) for a, b in groups for x in a for y in b)
            own = text == k
            assert {(p // sizes[1], p % sizes[1]): n for p, n in zip(pair[own].tolist(), times[own].tolist(), strict=True)} == links
            assert (got.n_groups[k], got.n_links[k], digests[k]) == (len(groups), sum(links.values()), digest(groups))


def test_chunks_cut_where_whole_texts_do(enc):
    """Encoding by chunks gives the ids of the whole text."""
    for text in TEXTS:
        numbers, _ = enc.chunks([text])
        if text:
            assert enc.ids_a.take(numbers)[0].tolist() == enc.a.encode(" " + text, add_special_tokens=False).ids
            assert enc.ids_b.take(numbers)[0].tolist() == enc.b.encode(text)


def test_forgotten_chunks_are_learned_again(enc, monkeypatch):
    monkeypatch.setattr(al, "CACHED_CHUNKS", 3)
    for _ in range(3):
        got = al.Aligned(enc, TEXTS[:2])
        assert got.n_a[0] == got.n_a[1] == sum(len(a) for a, _ in merged(enc, TEXTS[0]))


def test_lanes_of_different_length_finish_on_their_own():
    end_a, end_b = np.array([1, 3, 4, 6, 9]), np.array([2, 3, 4, 5, 6, 9])
    cuts = al.lockstep(end_a, end_b, np.array([0, 2]), np.array([2, 5]), np.array([0, 2]))
    assert [c.tolist() for c in cuts] == [[2, 3, 4, 5], [2, 3, 5, 6]]


@pytest.mark.parametrize("broadcast_pairs", [al.BROADCAST_PAIRS, 0])
def test_scores(spark, enc, broadcast_pairs):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "alpha beta again")]
    docs = frame(spark, "doc_id long, text string, row long, pair long", *[(i, t, 1, 1) for i, t in rows]).repartition(3)
    got = al.link_scores(docs, broadcast_pairs=broadcast_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(enc, rows)


def test_empty_table(spark):
    assert al.link_scores(frame(spark, "doc_id long, text string")).collect() == []
