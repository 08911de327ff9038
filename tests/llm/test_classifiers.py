"""Language ID and the quality classifier against plain models, fitted and applied text by text."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import langid, quality
from quern.llm.common import word_hashes

M32 = 0xFFFFFFFF
WORDS = {"en": "the of and house river walking people".split(), "de": "der und das haus fluss gehen über".split()}


def texts(n=48):
    rng = random.Random(5)
    odd = [None, "", "12 ²!", "é", "THE und THE\n\nTHE und\n", "The " * 3000]
    some = [" ".join(rng.choice(WORDS[("en", "de")[i % 2]]) for _ in range(rng.randint(1, 25))) for i in range(n)]
    return odd + [t.title() + "\nx!" if i % 5 == 0 else t for i, t in enumerate(some)]


def bucket(gram):
    h = (sum((ord(c) + 1) * int(m) for c, m in zip(gram, langid._MULT, strict=False)) + len(gram) * 0x27D4EB2F) & M32
    h ^= h >> 15
    h = h * 0x2C1B3C6D & M32
    return (h ^ h >> 12) % langid.BUCKETS


def grams(text):
    t = text.lower()
    return [bucket((t + "\n\n\n")[i : i + n]) for i in range(len(t)) for n in (1, 2, 3)]


@pytest.mark.parametrize("parts", [1, 7])
def test_languages_like_a_plain_naive_bayes(spark, parts):
    rows = [(i, t, None if i % 11 == 3 else ("en", "de")[i % 2]) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    counts, out = defaultdict(Counter), lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    for i, t, lang in rows:
        if lang and t is not None and not out(i):
            counts[lang].update(grams(t))
    total = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i].held_out == out(i)
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        mean = {x: sum(np.log((c[g] + 0.5) / total[x]) for g in grams(t)) / len(t) for x, c in counts.items()}
        odds = {x: np.exp((m - max(mean.values())) * min(len(t), 200)) for x, m in mean.items()}
        best = max(sorted(odds), key=odds.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(odds[best] / sum(odds.values()), abs=2e-4)


def sparse(text):
    """Columns and values of one text, feature by feature."""
    raw, hashes = text.encode(), word_hashes([text])[0].tolist()
    words, seen = max(len(hashes), 1), Counter(hashes)
    at = Counter(h % quality.BUCKETS for h in hashes)
    x = {c: np.sqrt(n / words) for c, n in at.items()}
    s = [sum(quality._CLASS[b] == k for b in raw) / max(len(raw), 1) for k in range(10)]
    lines = [y for y in text.split("\n") if y]
    s += [min(len(raw) / words / 20, 1), np.log1p(len(raw)) / 16, (len(hashes) - len(seen)) / words]
    s += [max(seen.values(), default=0) / words, 1 - len(set(lines)) / len(lines) if lines else 0, min(len(lines) / words, 1)]
    both = [*s, *np.sqrt(s), *((y > 0.02) * 0.5 for y in s), *((y > 0.1) * 0.5 for y in s)]
    x |= {quality.BUCKETS + k: y for k, y in enumerate(both)}
    return list(x), np.array(list(x.values()))


def plain_logit(w0, w, v, cols, x):
    vx = v[cols] * x[:, None]
    return w0 + w[cols] @ x + np.triu(vx @ vx.T, 1).sum()  # each pair by itself


def plain_machine(rows, y, rate=0.1, decay=1e-5):
    """AdaGrad over all rows at once, as many as one batch holds, gradients feature by feature."""
    rng, size = np.random.default_rng(7), quality.BUCKETS + quality.STRUCTURE
    p = float(np.clip(np.mean(y), 0.01, 0.99))
    w0, w, v = np.log(p / (1 - p)), np.zeros(size), rng.normal(0, 0.02, (size, quality.RANK))
    g0, gw, gv = 1.0, np.full(size, 1e-2), np.full((size, quality.RANK), 1e-2)
    for _ in range(30):
        e = [(1 / (1 + np.exp(-plain_logit(w0, w, v, *r))) - t) / len(y) for r, t in zip(rows, y, strict=True)]
        dw, dv = defaultdict(float), defaultdict(float)
        for (cols, x), err in zip(rows, e, strict=True):
            vx = v[cols] * x[:, None]
            for k, c in enumerate(cols):
                dw[c] += err * x[k]
                dv[c] = dv[c] + err * x[k] * (vx.sum(axis=0) - vx[k])
        g0 += sum(e) ** 2
        w0 -= rate * sum(e) / np.sqrt(g0)
        for c in dw:
            d, dd = dw[c] + decay * w[c], dv[c] + decay * v[c]
            gw[c] += d * d
            gv[c] += dd * dd
            w[c] -= rate * d / np.sqrt(gw[c])
            v[c] -= rate * dd / np.sqrt(gv[c])
    return w0, w, v


def test_quality_like_a_plain_machine(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    again = [r for r in rows if r[0] % 4 == 0] * 3  # repeated rows are fitted once
    docs = spark.createDataFrame(rows + again, "doc_id long, text string").repartition(3)
    marks = {i: int(i % 3 == 0) for i, _ in rows if i % 7 != 1}
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    fitted = [i for i in marks if not out(i)]
    assert len(fitted) <= 64
    each = [sparse(t or "") for _, t in rows]
    rounded = [(each[i][0], each[i][1].astype(np.float32).astype(float)) for i in fitted]
    model = plain_machine(rounded, [marks[i] for i in fitted])
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        want = 1 / (1 + np.exp(-plain_logit(*model, *each[i])))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].held_out == out(i)
        assert got[i].predicted == int(want >= 0.3)
