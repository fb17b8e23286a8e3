"""The line query against a plain fold over all lines, over whole tables."""

from __future__ import annotations

import collections
import re

from tallyframe.llm import queries as Q
from tallyframe.llm.common import read_table


def fields(line):
    return " ".join(re.sub(r"[^0-9]*[0-9].*", "<*>", t, flags=re.S) for t in line.split(" "))


def masked(line):
    found = fields(line)
    return found if 2 * found.count("<*>") <= line.count(" ") + 1 else line


def brute_lines(rows):
    """(id, text without recurring lines, number of dropped lines) by exact counts."""
    found = []  # row, place, leaf, masked line, context
    for r, (_, text) in enumerate(rows):
        parts = text.split("\n") if text is not None else []
        for p, part in enumerate(parts):
            line = part.strip(" ")
            if line:
                near = tuple(x for x in (parts[p - 1] if p else None, parts[p + 1] if p + 1 < len(parts) else None) if x is not None)
                found.append((r, p, (line.count(" "), fields(" ".join(line.split(" ")[:3]))), masked(line), near))
    size = collections.Counter(x[2] for x in found)
    found = [x for x in found if size[x[2]] >= 10]
    tokens = collections.defaultdict(collections.Counter)
    for _, _, leaf, line, _ in found:
        for at, token in enumerate(line.split(" ")):
            tokens[leaf, at][token] += 1
    top = {key: max((k, token) for token, k in c.items()) + (sum(c.values()),) for key, c in tokens.items()}
    fixed = {key: token if k >= 0.6 * every else None for key, (k, token, every) in top.items()}

    def cluster(leaf, line):
        own = line.split(" ")
        return leaf if sum(fixed[leaf, at] == t for at, t in enumerate(own)) >= 0.7 * len(own) else line

    groups = collections.defaultdict(list)
    for x in found:
        groups[cluster(x[2], x[3])].append(x)
    gone = collections.defaultdict(set)
    for members in groups.values():
        contexts, texts = len({x[4] for x in members}), len({rows[x[0]][1] for x in members})
        if len(members) >= 10 and contexts >= 10 and contexts >= 0.3 * texts:
            for x in members:
                gone[x[0]].add(x[1])
    return [
        (i, text if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone[r]), len(gone[r]))
        for r, (i, text) in enumerate(rows)
    ]


def test_line_query_matches_exact_counts(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = brute_lines(rows)
    got = [(r.doc_id, r.text, r.n_dropped) for r in Q.op8_line_dedup(spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(n for _, _, n in want)
