"""Models' outputs against slow versions of what their modules say."""

import re
import string
import zlib

import numpy as np
import pytest

from strandloom.llm import langid, quality, secrets


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_network_equals_a_loop_over_windows_filters_and_places():
    rng = np.random.default_rng(3)
    net = langid.ByteNet(["de", "en", "fr"], seed=5)
    net.bias += rng.normal(0, 0.1, net.bias.shape).astype(np.float32)
    net.prepare()
    texts = ["", "a", "Ein Satz, mit Wörtern.", "x" * 255 + "yz", "".join(rng.choice(list(string.ascii_letters + " é"), 700))]

    def softmax(window):
        hidden = []
        for w, f in zip(langid.WIDTHS, net.filters):
            for k in range(langid.FILTERS):
                hidden.append(max(float(net.embed[window[i : i + w]].ravel() @ f[:, k]) for i in range(langid.WINDOW - 3)))
        logits = np.maximum(np.array(hidden) + net.bias, 0) @ net.out + net.out_bias
        e = np.exp(logits - logits.max())
        return e / e.sum()

    got = net.documents(*buffer(texts))
    for text, row in zip(texts, got):
        raw = text.encode()
        want = np.zeros(3)
        for at in range(0, max(len(raw), 1), langid.WINDOW):
            piece = raw[at : at + langid.WINDOW]
            want += softmax(np.frombuffer(piece.ljust(langid.WINDOW, b" "), np.uint8)) * max(len(piece), 1)
        assert row == pytest.approx(want / max(len(raw), 1), abs=1e-5)


def test_network_learns_held_out_languages():
    rng = np.random.default_rng(4)
    letters = {"de": "enirstadhulcgmobwfkzäöü", "en": "etaoinshrdlcumwfgypbvk", "fr": "esaitnrulodcpmévqfbghjàx"}

    def text(lang):
        weights = 1.0 / np.arange(1, len(letters[lang]) + 1)
        return " ".join("".join(rng.choice(list(letters[lang]), rng.integers(2, 9), p=weights / weights.sum())) for _ in range(60))

    names = sorted(letters)
    windows = [(np.frombuffer(text(lang).encode()[: langid.WINDOW].ljust(langid.WINDOW, b" "), np.uint8), k) for k, lang in enumerate(names) for _ in range(150)]
    order = rng.permutation(len(windows))
    net = langid.ByteNet(names).fit(np.array([windows[i][0] for i in order]), np.array([windows[i][1] for i in order])).prepare()
    held = [(text(lang), k) for k, lang in enumerate(names) for _ in range(40)]
    assert (net.documents(*buffer([t for t, _ in held])).argmax(1) == [k for _, k in held]).mean() > 0.9


def test_features_and_scores_equal_their_definitions():
    texts = ["A b b, c!\nA b b, c!\n| # 12", "ÄÖ é " * 30, "x", "word " * 40000]
    x = quality.features(*buffer(texts))
    for text, row in zip(texts, x):
        raw = text.encode()
        pairs = np.zeros(quality.PAIRS)
        for a, b in zip(raw, raw[1:]):
            pairs[(((a << 8 | b) * 0x9E3779B1) & 0xFFFFFFFF) >> 23] += 1
        assert row[: quality.PAIRS] == pytest.approx(np.sqrt(pairs / max(len(raw) - 1, 1)), abs=1e-5)
        upper, lower = sum(65 <= c < 91 for c in raw), sum(97 <= c < 123 or c >= 128 for c in raw)
        spaces, digits = sum(c == 32 or 9 <= c < 14 for c in raw), sum(48 <= c < 58 for c in raw)
        lines, words = text.split("\n"), raw.split()
        packed = sum(len(zlib.compress(raw[a : a + (1 << 16)], 1)) for a in range(0, len(raw), 1 << 16))
        want = [
            np.log1p(len(raw)), upper / max(upper + lower, 1), (len(raw) - upper - lower - spaces - digits) / len(raw), digits / len(raw), spaces / len(raw), 1 - len(set(lines)) / len(lines),
            min(packed / len(raw), 1.2), raw.count(b"!") / len(raw), sum(c in b"#$%&*" for c in raw) / len(raw), raw.count(b"|") / len(raw), sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1), len(set(words)) / max(len(words), 1),
        ]
        assert row[quality.PAIRS :] == pytest.approx(want, abs=1e-4)
    rng = np.random.default_rng(1)
    model = quality.PositiveUnlabelled(0.5).fit(x[rng.integers(0, 2, 30)] + 0.01, x[rng.integers(0, 4, 60)], epochs=3)
    w, b, v, c = model.weights
    for row, score in zip(x, model.score(x)):
        z = np.clip((row - model.mean) / model.scale, -8, 8)
        z[quality.PAIRS :] *= 3
        logit = sum(max(sum(z[i] * w[i, h] for i in range(len(z))) + b[h], 0) * v[h] for h in range(len(v))) + c[0]
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-3)


def slow_spans(text, table, ratio):
    """Base spans, then runs cut at them, judged whole or by stretches, as the module says."""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    base.sort()
    value = lambda a, b: table[(secrets.ALPHABET.find(a) + 1) * secrets.SIDE + secrets.ALPHABET.find(b) + 1]
    out = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        if not re.search("[A-Za-z]", m[0]):
            continue
        at, pieces = m.start(), []
        for start, _, end in base:
            if start < m.end() and m.start() < end:
                pieces.append((at, start))
                at = max(at, end)
        for a, b in [p for p in pieces + [(at, m.end())] if p[1] - p[0] >= secrets.LEAST]:
            t = text[a:b]
            steps = [0.0] + [value(x, y) for x, y in zip(t, t[1:])]
            found = []
            if sum(steps) > ratio:
                found = [(0, len(t))]
            else:
                total = best = 0.0
                begin = first = last = 0
                for i, v in enumerate(steps):
                    if total <= 0 or best - total >= ratio:
                        if best > ratio:
                            found.append((first, last))
                        begin = first = max(i - 1, 0)
                        total, best, last = v, max(v, 0.0), i + 1
                    else:
                        total += v
                        if total > best:
                            best, first, last = total, begin, i + 1
                if best > ratio:
                    found.append((first, last))
            wide = []
            for x, y in found:
                while x and t[x - 1] in secrets.ALNUM:
                    x -= 1
                while y < len(t) and t[y] in secrets.ALNUM:
                    y += 1
                if wide and wide[-1][1] > x:
                    wide[-1] = (wide[-1][0], max(wide[-1][1], y))
                else:
                    wide.append((x, y))
            out += [(a + x, 3, a + y) for x, y in wide if y - x >= secrets.LEAST and re.search("[A-Za-z]", t[x:y])]
    return ",".join(f"{[*secrets.KINDS, 'markov'][k]}:{s}:{e}" for s, k, e in sorted(out))


def test_spans_equal_a_slow_scan(spark):
    rng = np.random.default_rng(17)
    words = "account service notification settings user profile update order message default handler".split()
    token = lambda n: "".join(rng.choice(list(secrets.ALNUM), n))
    texts = ["", "plain words only"]
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 8)):
            kind = rng.integers(7)
            path = "/".join(rng.choice(words, rng.integers(1, 6)))
            parts.append([path, token(int(rng.integers(12, 40))), f"{path}/{token(24)}", f"key={token(20)}-{path}", f"Token: '{token(9)}'", "AKIA" + token(18).upper(), token(40).lower().translate(str.maketrans(string.ascii_lowercase, "abcdef" * 4 + "ab"))][kind])
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = secrets.markov_table(docs)
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.find_secrets(docs, table)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == slow_spans(text, table, secrets.RATIO), text
    assert any("markov" in s for s in got.values())
