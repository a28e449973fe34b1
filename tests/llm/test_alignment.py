from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirelake.llm import alignment as al
from quirelake.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Per text: groups of (A ids, B ids), cut at every byte where tokens of both end; None without tokens."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = al.byte_of_char()

    def groups(text):
        if not text:
            return None
        raw = f" {text}".encode()
        left = a.encode(" " + text, add_special_tokens=False)
        xs = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in left.ids]
        ys = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        if any(b"".join(t for _, t in z) != raw for z in (xs, ys)):
            return None
        out, group, x, y = [], ([], []), 0, 0
        xs, ys = xs[::-1], ys[::-1]
        while xs or ys:
            side = 0 if x <= y and xs or not ys else 1
            i, t = (xs, ys)[side].pop()
            group[side].append(i)
            x, y = (x + len(t), y) if side == 0 else (x, y + len(t))
            if x == y:
                out.append(group)
                group = ([], [])
        return out

    return groups


def expected(plain, texts):
    all_groups = [plain(t) for t in texts]
    held = defaultdict(set)
    for k, groups in enumerate(all_groups):
        for a, b in groups or []:
            for x in a:
                for y in b:
                    held[x, y].add(k)
    most = defaultdict(int)
    for (x, _), ks in held.items():
        most[x] = max(most[x], len(ks))
    out = []
    for groups in all_groups:
        if not groups:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(len(held[p]) == most[p[0]] for p in links), sum(len(held[p]) for p in links), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "  two  spaces ", "a", "a", "<|endoftext|> <s> </s> <unk>", "marks ▁ inside", "tab\tnew\r\n\nline", "né ÀÉ ß ﬁ", "中文 字符 𝔘𝔫𝔦", "🙂🙂 👩‍👩‍👧",
    "x" * 5000, "a b " * 3000, "aaaaaaaaaaaab" * 300, "\x00\x01 \x7f", "0123456789 12,345.67", "é   　 ​", "<0x0A> <0x41>",
]


def rows(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_odd_texts_equal_the_plain_version(spark, docs, plain):
    found = rows(al.report(docs(*ODD, extra="n_a")))
    assert [found[k] for k in range(len(ODD))] == expected(plain, ODD)
    assert found[0][0] == 0 and found[7][0] == 0 and found[4][0] > 0


def test_whole_table(spark, plain):
    docs = table(spark, SMALL, "documents")
    listed = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(plain, [t for _, t in listed])
    assert rows(al.report(docs)) == {k: w for (k, _), w in zip(listed, want, strict=True)}


def test_join_equals_broadcast(spark, docs):
    found = al.aligned(docs(*ODD), keep_groups=True).persist()
    a, b = (rows(al.scored(found, held)) for held in (10**6, 0))
    assert a == b and len(a) == len(ODD)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in found.collect() if r.n_a)
    found.unpersist()


def test_repeated_rows_null_ids_and_empty_tables(spark, docs):
    found = al.report(docs((1, "one two"), (1, "one two"), (None, "one"), (2, None))).collect()
    assert len(found) == 4 and sorted(r.count_sum for r in found if r.doc_id == 1) == [5, 5]
    assert al.report(docs("a").limit(0)).count() == 0


@pytest.fixture(scope="module")
def aligner():
    return al.Aligner(A, B)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab éß▁ \n\t.,'1🙂中"), max_size=40))
def test_any_text(aligner, plain, text):
    found, want = aligner([text])[0], plain(text) or []
    assert found.groups == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want)
    assert found.n_links == sum(len(a) * len(b) for a, b in want) == found.times.sum()


def test_windows_are_remembered_and_pairs_survive_packing(aligner):
    first = aligner(["the same words again and again"])[0]
    n = len(aligner.memo)
    again = aligner(["the same words again and again"])[0]
    assert len(aligner.memo) == n and first.groups == again.groups
    for x, y in [(first.pairs, first.times), (np.zeros(0, np.int64), np.zeros(0, np.int64)), (np.array([5, 1 << 47]), np.array([3, 70000]))]:
        p, t = al.unpacked(al.packed(x, y))
        assert (p == x).all() and (t == y).all()


def test_ordinary_windows_leave_nothing_in_memory(plain):
    """Windows that do not come again used to make an object each, and cost most of the time."""
    aligner, text = al.Aligner(A, B), " ".join(f"word{k}" for k in range(500))
    want = plain(text)
    assert aligner([text])[0].groups == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want)
    assert not aligner.memo


@pytest.mark.parametrize(("stretch", "listed", "memo"), [(1, 256, 10), (3, 1, 1), (50, 0, 2)])
def test_stretches_and_counted_groups_change_nothing(plain, monkeypatch, stretch, listed, memo):
    monkeypatch.setattr(al, "STRETCH", stretch)
    monkeypatch.setattr(al, "LISTED", listed)
    monkeypatch.setattr(al, "MEMO", memo)
    aligner = al.Aligner(A, B)
    for _ in range(2):
        for text, found in zip(ODD, aligner(ODD), strict=True):
            want = plain(text) or []
            links = sorted(x << 32 | y for a, b in want for x in a for y in b)
            assert found.groups == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want)
            assert np.repeat(found.pairs, found.times).tolist() == links
    assert len(aligner.memo) <= memo


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.characters(max_codepoint=0x2040), max_size=60))
def test_both_libraries_agree(aligner, text):
    assert aligner.quick is not None
    for t in (" " + text, " " + "".join(c for c in text if al._PLAIN.fullmatch(c))):
        assert aligner.left([t])[0] == aligner.a.encode(t, add_special_tokens=False).ids
