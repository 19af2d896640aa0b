"""Operators that SQL can't express, against plain versions that share no code with them."""

import cmath
import math
import random

import numpy as np
import pytest

from streamledger.llm import html_extraction, licences, media, toxicity

# 1: whole licence texts, as they stand in files


def test_licence_files(spark):
    s = licences.SENTENCES
    clause = lambda k, name: f"{k}. {s[name]}.\n\n"
    bsd = "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + s["bsd-redistribution"] + ":\n\n" + clause(1, "bsd-source") + clause(2, "bsd-binary")
    end = s["bsd-as-is"].replace(" ", "\n", 9) + ". " + s["bsd-liability"] + ".\n"
    texts = {
        "BSD-3-Clause": bsd + clause(3, "bsd-names") + end,
        "BSD-2-Clause": bsd + end,
        "AGPL-3.0-or-later": ".\n\n".join(s[k] for k in ("agpl3-free", "gpl-hope", "agpl-see", "agpl-received")) + ".",
        "LGPL-2.1-or-later": ".\n# ".join(s[k] for k in ("lgpl21-free", "lgpl-hope", "lgpl-see")) + ".",
        "LGPL-3.0-or-later": "SPDX-License-Identifier: LGPL-3.0-or-later\n",
        "Zlib": "  ".join(s[k] + "." for k in ("zlib-as-is", "zlib-event", "zlib-grant")),
        "EPL-2.0": s["epl2-program"] + "\n\nSPDX-License-Identifier: EPL-2.0",
        "BSL-1.0": s["boost-distributed"] + ".\n(See accompanying file)",
        "Unlicense": s["unlicense-free"] + ".\n\n" + s["unlicense-anyone"] + ".",
        "CC-BY-NC-SA-4.0": s["cc-by-nc-sa-work"] + ".",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan_licences(rows).collect()}
    assert got == {k: [k] for k in texts}
    assert len({licences.normalised(x) for x in s.values()}) == len(s)


# 2: the fingerprint by sums of sines


def plain_fingerprint(data):
    frames = []
    for start in range(0, len(data) - 575, 288):
        x = [(data[start + k] - 128) * (0.5 - 0.5 * math.cos(2 * math.pi * k / 575)) for k in range(576)]
        turn = [cmath.exp(-2j * math.pi * k / 576) for k in range(576)]
        m = [round(abs(sum(v * turn[f * k % 576] for k, v in enumerate(x))), 6) for f in range(289)]
        mean = sum(m) / 289
        tops = [f for f in range(1, 288) if m[f] > m[f - 1] and m[f] >= m[f + 1] and m[f] > mean]
        frames.append(sorted(tops, key=lambda f: (-m[f], f))[:3])
    peaks = [(t, f) for t, fs in enumerate(frames) for f in fs]
    pairs, met = [], set()
    for i, (t, f) in enumerate(peaks):
        for j in range(i + 1, len(peaks)):
            u, g = peaks[j]
            if u - t <= 3:
                pairs.append((t, f << 13 | g << 3 | u - t))
                met |= {i, j}
    return sorted(pairs + [(t, f << 13 | f << 3) for i, (t, f) in enumerate(peaks) if i not in met])


@pytest.mark.parametrize("text", ["", "x", "short text of a few words", "the quick brown fox " * 60, "".join(random.Random(5).choices("abcdefgh é\n", k=3000)), "aaaa" * 400])
def test_fingerprints_are_those_of_plain_sums(text):
    data = media.padded(text.encode())
    got = media.fingerprint(data)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == plain_fingerprint(data)


def test_one_peak_has_a_fingerprint():
    tone = np.round(128 + 100 * np.sin(2 * np.pi * 40 * np.arange(576) / 576)).astype(np.uint8).tobytes()
    times, codes = media.fingerprint(tone)
    assert len(times) >= 1 and 40 << 13 | 40 << 3 in codes.tolist()


# 6: noisy-or and its gradient


def loss_of(w, bags):
    """Negative log likelihood of the bags' labels: a bag is clean if all its sentences are."""
    total = 0.0
    for y, slots, sizes in bags:
        clean, at = 1.0, 0
        for n in sizes:
            z = w[-1] + sum(w[s] for s in slots[at : at + n])
            at += n
            clean *= 1 - 1 / (1 + math.exp(-z))
        total -= math.log(1 - clean) if y else math.log(clean)
    return total / len(bags)


def test_steps_follow_the_gradient_of_the_likelihood(monkeypatch):
    """One step of the training from its start goes against the numeric gradient, slot by slot."""
    draw = random.Random(2)
    bags = [(k % 2, np.array([draw.randint(0, 9) for _ in range(6)], np.int64), np.array([2, 3, 1])) for k in range(8)]
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "MIN_DOCS", 1)
    monkeypatch.setattr(toxicity, "BIAS", -1.0)
    moved = toxicity.fit(bags)
    start = np.zeros(toxicity.SLOTS + 1)
    start[-1] = -1.0
    for slot in [*range(10), -1]:
        up, down = start.copy(), start.copy()
        up[slot] += 1e-5
        down[slot] -= 1e-5
        slope = (loss_of(up, bags) - loss_of(down, bags)) / 2e-5
        assert abs(slope) < 1e-6 or np.sign(moved[slot] - start[slot]) == -np.sign(slope)
    assert np.all(moved[10:-1] == 0)


def test_scores_are_noisy_or():
    draw = np.random.default_rng(1)
    weights = draw.normal(0, 1, toxicity.SLOTS + 1).astype(np.float32)
    scorer = toxicity.Scorer(weights)
    for text in ("One sentence here. Another one! And a third? yes", "word", "", None, "a b c d\n\ne f g.", "Same same. Same same."):
        clean, spans = 1.0, []
        for m in toxicity.SENTENCE.finditer(text or ""):
            words = {w for w in "".join(c.lower() if c.isalnum() else " " for c in m.group()).split()}
            if words:
                z = float(weights[-1]) + sum(float(weights[s]) for w in words for s in toxicity.word_slots(w))
                clean *= 1 / (1 + math.exp(z))
                spans.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
        score, offending = scorer.score(text)
        assert score == pytest.approx(1 - clean, abs=1e-5)
        assert {(o["start"], o["end"]) for o in offending} >= {(a, b) for a, b, p in spans if p > 0.5001}


# 9: pages that are nothing like the ones it learns from

PAGES = [
    (
        """<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>River ferries return</title><link rel=stylesheet href=a.css></head>
<body class="post-template-default single"><a class=skip href=#c>Skip to content</a>
<header id=masthead><h2>The Daily Harbour</h2><nav aria-label=Main><ul><li><a href=/>Home</a><li><a href=/news>News</a><li><a href=/sport>Sport</a></ul></nav></header>
<main id=c><article><h1>River ferries return after a long winter</h1>
<p>The first ferry of the year crossed the river on Monday morning, carrying forty passengers and a small brass band to the northern bank.</p>
<p>Captain Moreau said that the ice had gone two weeks earlier than expected, and that crews had worked through the nights to repaint the hulls.</p>
<blockquote><p>We have waited for this day since November, and the children have waited longer.</p></blockquote>
<p>Tickets cost three crowns, and the timetable is posted at both piers.</p></article>
<aside class=sidebar><h3>Most read</h3><ol><li><a href=/1>Bridge closed</a></li><li><a href=/2>Market moves</a></li></ol></aside></main>
<section class=comments id=comments><h3>3 comments</h3><div class=comment><p>Lovely news, see you on board!</p></div></section>
<footer class=site-footer><p>&copy; 2024 The Daily Harbour. All rights reserved. <a href=/privacy>Privacy</a></p></footer></body></html>""",
        ["The first ferry of the year crossed the river on Monday morning", "ice had gone two weeks earlier", "We have waited for this day since November", "Tickets cost three crowns"],
        ["Skip to content", "Sport", "Most read", "Bridge closed", "Lovely news", "All rights reserved", "Privacy"],
    ),
    (
        """<html><body><table width=100%><tr><td colspan=2><div class=topnav><a href=a>Index</a> | <a href=b>Archive</a> | <a href=c>Contact</a></div></td></tr>
<tr><td valign=top class=menu><ul><li><a href=d>Gardens</a></li><li><a href=e>Trees</a></li></ul></td>
<td class=content><h1>How to graft an apple tree</h1><p>Grafting joins a twig of the wanted variety to the rooted stem of another tree, so that both grow on as one plant.</p>
<p>Cut the scion in late winter while the buds are still asleep, wrap it in damp paper, and keep it in a cold cellar until the sap rises in spring.</p>
<ul><li>Choose a stem as thick as a pencil, without scars or disease.</li><li>Make one long slanting cut with a single stroke of a clean knife.</li></ul>
<p>Bind the joint tightly with tape, and seal it with wax so that it does not dry out.</p></td></tr></table>
<div class=footer>Copyright by the garden society. <a href=imprint>Imprint</a></div></body></html>""",
        ["Grafting joins a twig of the wanted variety", "Cut the scion in late winter", "Choose a stem as thick as a pencil", "Bind the joint tightly with tape"],
        ["Archive", "Imprint", "garden society"],
    ),
    (
        """<body><div class="cookie-banner notice" role=dialog><p>We use cookies to improve your visit.</p><button>Accept all</button></div>
<div id=page><div class=entry-content><p>Every evening the lamplighter walked the length of the quay with his ladder on his shoulder and a dog at his heels.</p>
<p>He knew each of the sixty lamps by its hiss, and he could tell from the colour of the flame whether rain was coming before the morning.</p>
<script>track({page: "<p>not text</p>"});</script><div class="advertisement ad-slot"><p>Buy two lamps, get one free today only!</p></div>
<p>When the electric lights came he was given a clock, a pension and the smallest of the lamps, which still hangs above his door.</p></div>
<div class=share-bar><a href=x>Share</a> <a href=y>Tweet</a></div><form action=/s><label>Subscribe to our newsletter</label><input name=q></form></div></body>""",
        ["Every evening the lamplighter walked", "He knew each of the sixty lamps", "When the electric lights came he was given a clock"],
        ["cookies", "Accept all", "not text", "get one free", "Tweet", "newsletter"],
    ),
]


@pytest.fixture(scope="module")
def extractor():
    return html_extraction.Extractor(html_extraction.train())


@pytest.mark.parametrize("at", range(len(PAGES)))
def test_pages_not_from_the_generator(extractor, at):
    page, wanted, unwanted = PAGES[at]
    (text,) = extractor.extract([page])
    assert [w for w in wanted if w not in text] == [] and [u for u in unwanted if u in text] == []
