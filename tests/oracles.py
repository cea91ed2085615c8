"""Plain-Python oracles, written from the operator specifications (not from
the library code), used to check the Spark operators on fixtures."""

from __future__ import annotations

import math


def split_oracle(text, size, overlap, seps=("\n\n", "\n", " ", "")):
    """Recursive character split, straightforward list form."""
    def pieces(t, sep):
        if sep == "":
            return [c for c in t]
        parts = t.split(sep)
        res = [parts[0]] + [sep + p for p in parts[1:]]
        return [p for p in res if p != ""]

    def merge(ps):
        docs, cur, total = [], [], 0
        for p in ps:
            if total + len(p) > size and len(cur) > 0:
                d = "".join(cur).strip()
                if d != "":
                    docs.append(d)
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(cur[0])
                    cur = cur[1:]
            cur = cur + [p]
            total += len(p)
        d = "".join(cur).strip()
        if d != "":
            docs.append(d)
        return docs

    def rec(t, ss):
        sep = ss[-1]
        rest = []
        for i, s in enumerate(ss):
            if s == "":
                sep = s
                break
            if s in t:
                sep = s
                rest = list(ss[i + 1:])
                break
        out, good = [], []
        for p in pieces(t, sep):
            if len(p) < size:
                good.append(p)
            else:
                if good:
                    out += merge(good)
                    good = []
                out += rec(p, rest) if rest else [p]
        if good:
            out += merge(good)
        return out

    return rec(text, list(seps)) if text else []


def round_robin(*lists):
    out, i = [], 0
    while any(i < len(x) for x in lists):
        for x in lists:
            if i < len(x):
                out.append(x[i])
        i += 1
    return out


def long_context_order(items):
    """Reverse, then alternately put at the front / append at the end."""
    res = []
    for i, v in enumerate(reversed(list(items))):
        if i % 2 == 1:
            res.append(v)
        else:
            res.insert(0, v)
    return res


def mmr_oracle(query, cands, k, lam):
    def cos(a, b):
        na = math.sqrt(sum(x * x for x in a))
        nb = math.sqrt(sum(x * x for x in b))
        return 0.0 if na == 0 or nb == 0 else sum(x * y for x, y in zip(a, b)) / (na * nb)

    n = len(cands)
    if min(k, n) <= 0:
        return []
    qs = [cos(query, c) for c in cands]
    best = max(range(n), key=lambda i: (qs[i], -i))
    picked = [best]
    while len(picked) < min(k, n):
        best_score, best_i = -math.inf, -1
        for i in range(n):
            if i in picked:
                continue
            red = max(cos(cands[i], cands[j]) for j in picked)
            sc = lam * qs[i] - (1 - lam) * red
            if sc > best_score:
                best_score, best_i = sc, i
        picked.append(best_i)
    return picked


def mcq_prompt_oracle(question, context, options, answer=None, explanation=None, train=False):
    lines = "".join(f"{k}: {v}\n" for k, v in options)
    s = ("### Instructions: \n"
         "Based on the provided context, select the correct answer from the choices given. "
         "Provide your answer in the following format: option Number: Answer.\n\n"
         f"Context:\n{context}\n\nQuestion:\n{question}\nChoices:\n{lines}\n### Answer:")
    if train:
        s += f"\n{answer or ''}\n### Explanation:\n{explanation or ''}\n"
    return s


def qa_prompt_oracle(question, context, explanation=None, train=False):
    s = ("### Instructions: \nBased on the provided context, answer the question.\n\n"
         f"Context:\n{context}\n\nQuestion:\n{question}\n\n### Answer:")
    if train:
        s += f"\n{explanation or ''}\n"
    return s


def completion_mask_oracle(labels, marker):
    m = len(marker)
    for p in range(len(labels)):
        if m and labels[p:p + m] == marker:
            end = p + m
            return [-100] * end + labels[end:]
    return [-100] * len(labels)


def answer_parse_oracle(text):
    return text.split(":")[0][-1:].strip(" \t\n\r\f\v")


def hash_embed_oracle(text, dim=256):
    import hashlib

    import regex

    toks = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    v = [0.0] * dim
    for t in toks:
        v[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += 1.0
    n = math.sqrt(sum(x * x for x in v))
    import numpy as np

    return (np.array(v) / (n if n > 0 else 1.0)).astype(np.float32).astype(np.float64)


def words_oracle(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
