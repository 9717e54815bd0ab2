"""The license scan against semi-global edit distances over whole texts, at all positions, and with wrong rankings."""

import random

import pytest

from corvane.llm import license_scan

RNG = random.Random(11)
PROSE = [f"{RNG.choice('bcdfglmnprst')}{RNG.choice('aeiou')}{RNG.choice('bcdlmnrst')}{RNG.choice(['', 'a', 'en', 'ing', 'ed', 'ist'])}" for _ in range(3000)]
WORDS = {n: license_scan.words_of(t) for n, t in license_scan.TEMPLATES.items()}


@pytest.fixture(scope="module")
def scanner():
    return license_scan.Scanner(license_scan.TEMPLATES)


def brute(words):
    """(license, last word, differing) of the best stretch of each template, word by word: edits to make the template a stretch of the words."""
    out = {}
    for name, own in WORDS.items():
        line = [0] * (len(words) + 1)
        for i, w in enumerate(own):
            before, line = line, [i + 1]
            for j, x in enumerate(words):
                line.append(min(before[j] + (w != x), before[j + 1] + 1, line[j] + 1))
        best = min(line)
        if best <= int(license_scan.DIFFERENT * len(own)):
            out[name] = (best, len(own) - best)
    return out


def changed(name, rng):
    words = license_scan.TEMPLATES[name].split()
    for _ in range(rng.randrange(int(license_scan.DIFFERENT * len(WORDS[name])) + 1)):
        k, how = rng.randrange(len(words)), rng.random()
        if how < 0.4:
            words.insert(k, rng.choice(PROSE))
        elif not any(c.isdigit() for c in words[k]) and len(license_scan.words_of(words[k])) == 1:
            words[k : k + 1] = [rng.choice(PROSE)] if how < 0.7 else []
    return words


@pytest.mark.parametrize("seed", range(3))
def test_against_edit_distances_over_whole_texts(scanner, seed):
    rng = random.Random(seed)
    for _ in range(40):
        name = rng.choice(list(WORDS))
        before, after = rng.randrange(80), rng.randrange(80)
        text = " ".join(PROSE[:before] + changed(name, rng) + PROSE[1000 : 1000 + after])
        want = brute(license_scan.words_of(text))
        (got,) = scanner.scan(text)
        start, stop, license, _, differing, exact = got
        most = max(agreeing for _, agreeing in want.values())
        assert want[license] == (differing, most) and exact == (differing == 0), (got, want)
        stretch = license_scan.words_of(text[start:stop])
        assert brute(stretch)[license] == want[license]  # the place holds all of it
        assert stretch[0] in WORDS[license] and stretch[-1] in WORDS[license]


def test_prose_alone_has_none(scanner):
    for k in range(0, 2900, 100):
        text = " ".join(PROSE[k : k + 90] + ["license", "version", "permission", "terms"] + PROSE[k : k + 40])
        assert scanner.scan(text) == [] and not brute(license_scan.words_of(text))


@pytest.mark.parametrize("at", range(100))
def test_words_put_in_at_every_position(at):
    """A template of 48 words with 7 more in it, the most that may differ, wherever it stands."""
    rng = random.Random(5)
    own = rng.sample(sorted({f"{a}{b}" for a in PROSE[:80] for b in ("ux", "oy", "iz")}), 48)
    scanner = license_scan.Scanner({"own": " ".join(own)})
    words = own[:]
    for k in (6, 12, 18, 24, 30, 36, 42):
        words.insert(k, "insertion")
    text = " ".join(PROSE[:at] + words + PROSE[500:700])
    ((start, stop, _, _, differing, _),) = scanner.scan(text)
    assert text[start:stop] == " ".join(words) and differing == 7


def test_verbatim_notices_save_enough(scanner):
    """However they stand, exact notices keep well clear of the least share."""
    rng, least = random.Random(9), 1.0
    for name, t in license_scan.TEMPLATES.items():
        for _ in range(12):
            a, b = rng.randrange(200), rng.randrange(200)
            text = " ".join(PROSE[rng.randrange(500) :][:a] + [t] + PROSE[900:][:b])
            (found,) = scanner.scan(text)
            assert found[2] == name and found[5]
            least = min(least, found[3])
    assert least > 1.5 * license_scan.LEAST_SHARE


def test_the_ranking_decides(scanner, monkeypatch):
    """With the sizes of other blocks than their own, templates are confirmed in another order, or not at all."""
    text = " ".join(PROSE[:30] + [license_scan.TEMPLATES["MIT-text"]] + PROSE[40:90] + [license_scan.TEMPLATES["GPL-2.0-header"]] + PROSE[90:99])
    calls = []
    confirm = license_scan.Scanner.confirm
    monkeypatch.setattr(license_scan.Scanner, "confirm", staticmethod(lambda t, words: calls.append(t.name) or confirm(t, words)))
    right = scanner.scan(text)
    true_calls = calls[:]
    assert [r[2] for r in right] == ["MIT-text", "GPL-2.0-header"]

    class Wrong:
        def __init__(self, of):
            self.of = of

        def compress(self, raw):
            return bytes(max(0, 100 - len(self.of.compress(raw)) // 8))  # the worse, the smaller

    class Never(Wrong):
        def compress(self, raw):
            return raw + raw

    for kind in (Wrong, Never):
        calls.clear()
        other = license_scan.Scanner(license_scan.TEMPLATES)
        for t in other.templates:
            t.given = kind(t.given)
        got = other.scan(text)
        assert calls != true_calls
        if kind is Never:
            assert got == [] and calls == []
