"""Token alignment against a plain model, and on odd rows."""

from __future__ import annotations

import collections
import hashlib

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyframe.llm.common import read_table
from tallyframe.llm.token_alignment import MEASURES, align_tokenizers, byte_alphabet

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    a_tool = Tokenizer.from_file(PATHS[0])
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = byte_alphabet()

    def spans(ids, token):
        out, at = [], 0
        for i in ids:
            raw = token(i)
            out.append((i, at, at + len(raw), raw))
            at += len(raw)
        return out

    def piece(i):
        name = b_tool.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b_tool.is_byte(i) else name.replace("▁", " ").encode()

    done, held = [], collections.Counter()
    for i, text in rows:
        links, groups, n = [], [], (0, 0)
        if text:
            a = spans(a_tool.encode(" " + text, add_special_tokens=False).ids, lambda t: bytes(letters[c] for c in a_tool.id_to_token(t)))
            b = spans(b_tool.encode(text), piece)
            whole = (" " + text).encode()
            if b"".join(s[3] for s in a) == whole == b"".join(s[3] for s in b):
                n = len(a), len(b)
                links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 300 else walk(a, b)
                both = sorted({s[2] for s in a} & {s[2] for s in b})
                start = 0
                for end in both:
                    groups.append((start, end))
                    start = end
        text_groups = render(a, b, groups) if groups else ""
        held.update(set(links))
        done.append((i, *n, links, groups, hashlib.sha256(text_groups.encode()).hexdigest() if groups else ""))
    top = collections.defaultdict(int)
    for (x, _), c in held.items():
        top[x] = max(top[x], c)
    return sorted(
        ((i, na, nb, len(g), len(ls), sum(held[p] == top[p[0]] for p in ls), sum(held[p] for p in ls), d) for i, na, nb, ls, g, d in done), key=str
    )


def walk(a, b):
    links, j = [], 0
    for x in a:
        while b[j][2] <= x[1]:
            j += 1
        k = j
        while k < len(b) and b[k][1] < x[2]:
            links.append((x[0], b[k][0]))
            k += 1
    return links


def render(a, b, groups):
    out, i, j = [], 0, 0
    for _, end in groups:
        left, right = [], []
        while i < len(a) and a[i][2] <= end:
            left.append(str(a[i][0]))
            i += 1
        while j < len(b) and b[j][2] <= end:
            right.append(str(b[j][0]))
            j += 1
        out.append(",".join(left) + "|" + ",".join(right))
    return ";".join(out)


COLUMNS = ("doc_id", *MEASURES, "groups_sha256")


def test_whole_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    got = sorted(map(tuple, align_tokenizers(docs, *PATHS).select(*COLUMNS).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("frequent", [0, 5, 1 << 17])
def test_odd_rows(spark, monkeypatch, frequent):
    from tallyframe.llm import token_alignment

    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)  # either way of looking counts up gives the same
    long = " ".join(f"word{k % 700} naïve 漢字" for k in range(20_000))
    texts = [None, "", " ", "\n\n", "a", "Hello world", "Hello world", "Hello  world ", "a▁b", "end <|endoftext|> <s> <0x41>", "naïve 漢字 \u0001", "x" * 3000, long, long]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, "Hello world"), (None, "Hello world"), (None, None)]
    made = spark.createDataFrame([(i, t, 1, "y", 2) for i, t in rows], "doc_id long, text string, cls long, pairs string, n int")
    got = sorted(map(tuple, align_tokenizers(made, *PATHS).select(*COLUMNS).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    made = spark.createDataFrame([], "doc_id long, text string")
    out = align_tokenizers(made, *PATHS)
    assert out.count() == 0 and set(out.columns) == set(COLUMNS)
