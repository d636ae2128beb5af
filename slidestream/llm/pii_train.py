"""Makes ``pii_model.json``: ``python -m slidestream.llm.pii_train``.

The trees learn from one generator of snippets. Margins are calibrated, and thresholds set, on a second one that shares neither contexts
nor templates with the first, so a form that the trees only know by heart costs them there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from slidestream.llm.pii import AGAINST, CARD, CUES, EMAIL, IP, MODEL, PHONE, Judge, Scorer, Trees, _to_json, candidates, features, likeliest, luhn

#: Of the calibration snippets' selected candidates, the share that must be personal data.
PRECISION = 0.98
Snippet = tuple[str, list[tuple[int, int]]]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 50, rate: float = 0.2, bins: int = 32) -> Trees:
    """Newton boosting on the logistic loss."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    p0 = np.clip(y.mean(), 0.01, 0.99)
    trees = Trees(edges, np.zeros((rounds, 7), np.int64), np.zeros((rounds, 7), np.int64), np.zeros((rounds, 8)), float(np.log(p0 / (1 - p0))))
    b = trees.binned(x)
    n_bins = bins + 1
    margin = np.full(len(x), trees.prior)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(3):
            first = (1 << level) - 1
            for k in range(first, 2 * first + 1):
                own = np.flatnonzero(node == k)
                best = (1e-6, 0, n_bins)  # no split: all go left
                if len(own) > 10:
                    total_g, total_h = g[own].sum(), h[own].sum()
                    for f in range(x.shape[1]):
                        if not len(edges[f]):
                            continue
                        left_g = np.cumsum(np.bincount(b[own, f], g[own], n_bins))[: len(edges[f])]
                        left_h = np.cumsum(np.bincount(b[own, f], h[own], n_bins))[: len(edges[f])]
                        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                        gain[(left_h < 0.5) | (total_h - left_h < 0.5)] = 0
                        at = int(np.argmax(gain))
                        if gain[at] > best[0]:
                            best = (float(gain[at]), f, at)
                trees.feature[r, k], trees.bin[r, k] = best[1], best[2]
            node = 2 * node + 1 + (b[np.arange(len(x)), trees.feature[r, node]] > trees.bin[r, node])
        leaf = node - 7
        trees.leaf[r] = rate * np.bincount(leaf, g, 8) / (np.bincount(leaf, h, 8) + 1)
        margin += trees.leaf[r][leaf]
    return trees


class Forms:
    """Numbers and words at random."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, *xs: str) -> str:
        return xs[self.rng.integers(len(xs))]

    def number(self, k: int, first: str = "123456789") -> str:
        return self.pick(*first) + (f"{self.rng.integers(10 ** (k - 1)):0{k - 1}d}" if k > 1 else "")

    def card(self, size: int = 16, first: str = "3456") -> str:
        body = self.number(size - 1, first)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def no_card(self, size: int = 16) -> str:
        """Digits that fail Luhn: any others of that length are a card by the base rule."""
        while luhn(s := self.number(size)):
            pass
        return s

    def joined(self, *parts: tuple[str, bool]) -> Snippet:
        """Pieces in a row; those marked are personal data."""
        out, spans = "", []
        for s, own in parts:
            if own:
                spans.append((len(out), len(out) + len(s)))
            out += s
        return out, spans


# ---------------------------------------------------------------- what the trees learn from


def training_snippets(n: int, rng: np.random.Generator) -> Iterator[Snippet]:
    """Invented words around personal data and what looks like it."""
    f = Forms(rng)
    pick, number = f.pick, f.number
    word = lambda: "".join(pick("ta", "re", "lo", "mi", "ser", "an", "ö", "é", "st", "ku", "ven", "di") for _ in range(rng.integers(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    any_card = lambda: f.card(int(pick("16", "16", "16", "15", "13", "19")), pick("3456", "3456", "123456789"))

    def phone() -> str:
        return pick(
            f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"0{number(3)} {number(3)} {number(4)}",
            f"00{number(2)} {number(2)} {number(7)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"0{number(3)}/{number(3)} {number(4)}", f"{number(3)} {number(3)} {number(3)}", f"0{number(3)}-{number(6)}",
            f"{number(3)} {number(3)} {number(4)}", f"0{number(2)}-{number(4)}-{number(4)}", f"(0{number(2)}) {number(4)} {number(4)}")

    def plus_phone() -> str:
        return pick(f"+1 ({number(3)}) {number(3)}-{number(4)}", f"+{number(2)} {number(2)} {number(7)}", f"+{number(2)} {number(3)} {number(3)} {number(3)}", f"+1-{number(3)}-{number(3)}-{number(4)}", f"+{number(2)}{number(9)}")

    def personal() -> Snippet:
        kind = int(rng.integers(6))
        if kind == EMAIL:
            at = pick(" at ", " AT ", " [at] ", "[at]", "(at)", " (at) ", "{at}", " @ ", "@")
            spelled = at.strip().lower() == "at"
            dot = pick(" dot ", " [dot] ", "[dot]") if spelled else pick(" dot ", " [dot] ", "[dot]", "(dot)", "[.]", "(.)", ".", ".")
            name = f"{word()}{pick('', '.', '_') + word()}{pick('', number(2))}"
            return f.joined((f"{name}{at}{word()}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk')}", True))
        if kind == IP:
            if rng.random() < 0.4:
                dot = pick("[.]", "(.)", "[dot]")
                return f.joined((dot.join(str(rng.integers(256)) for _ in range(4)), True))
            h = [f"{rng.integers(65536):x}" for _ in range(8)]
            h[0] = pick("2001", "fe80", "2a02", "fd00", h[0])
            return f.joined((":".join(h) if rng.random() < 0.6 else ":".join(h[: rng.integers(2, 4)]) + "::" + ":".join(h[6 : rng.integers(7, 9)]), True))
        if kind == CARD:
            c, s = any_card(), pick(".", "  ", "/", " - ", "–", "_", ". ")
            cuts = {15: (4, 10)}.get(len(c), tuple(range(4, len(c), 4)))
            return f.joined((s.join(c[a:b] for a, b in zip((0, *cuts), (*cuts, len(c)))), True))
        if kind == PHONE:
            return f.joined((phone(), True))
        if kind == 4:  # a card next to other digits
            grouped = pick("", " ", "-")
            one, two = (grouped.join(c[k : k + 4] for k in range(0, 16, 4)) for c in (f.card(), f.card(16, "123456789")))
            other = pick(number(2), number(3), f"{number(2)}/{number(2)}", f.no_card(), number(5))
            return pick_snippet(((one, True), (" ", False), (two, True)), ((one, True), (" ", False), (other, False)), ((other, False), (" ", False), (one, True)))
        return pick_snippet(((plus_phone(), True), (pick(" ", " - ", " ("), False), (pick(number(3), number(4), number(8), f.no_card()), False)), ((plus_phone(), True), (" ", False), (plus_phone(), True)))

    def pick_snippet(*forms) -> Snippet:
        return f.joined(*forms[rng.integers(len(forms))])

    def alike() -> str:
        y, m, d = rng.integers(1950, 2031), rng.integers(1, 13), rng.integers(1, 29)
        c = any_card()
        return pick(
            f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{d}/{m}/{y}", f"{y}-{y + rng.integers(1, 9)}", f"{y}–{y % 100 + 1:02d}", f"{rng.integers(24):02d}:{rng.integers(60):02d}:{rng.integers(60):02d}",
            f"{number(2)}.{number(2)}.{number(3)}", f"{number(1)}.{number(3)}.{number(3)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", number(16), number(12), number(10), f"0{number(9)}", f"{number(4)} {number(4)} {number(4)} {number(3)}",
            f"{number(4)}.{number(4)}.{number(4)}.{number(4)}", f"{number(4)}/{number(4)}/{number(4)}/{number(4)}", f"{number(3)} - {number(3)}", f"{number(2)} {number(3)} {number(2)}", f"{number(5)}-{number(4)}",
            f"{c[:2]} {c[2:5]} {c[5:7]} {c[7:10]} {c[10:]}", f"{c[:5]}.{c[5:7]}.{c[7:]}", f"{c[:1]}/{c[1:6]}/{c[6:]}", " ".join(number(int(rng.integers(1, 5))) for _ in range(rng.integers(3, 12))), " ".join(number(2) for _ in range(rng.integers(5, 14))), ".".join(number(2) for _ in range(rng.integers(5, 9))),
            f"pages {number(3)}-{number(3)}", f"{number(2)}/{number(2)}", f"{y} {number(2)} {number(3)} {number(4)}", ":".join(f"{rng.integers(256):02x}" for _ in range(6)), f"{y}-{m:02d}-{d:02d} {rng.integers(24):02d}:{rng.integers(60):02d}:{rng.integers(60):02d}",
            f"look at {word()} and dot {word()}", f"{word()} at {word()} dot {word()}{word()}ing", f"{word()} at home.{word()} {word()}", f"{word()} @ {word()}", f"std::{word()}::{number(2)}", f"{number(3)} {number(3)} {number(3)} {number(3)}", f"1:{number(2)}:{number(3)}:{number(1)}", f"{number(2)} {number(2)} {number(2)} {number(2)} {number(2)}",
            f"{number(4)} {number(4)}", f"v{number(1)}.{number(2)}.{number(2)}.{number(1)}.{number(2)}", f"+{number(3)} {number(3)}", f"+{number(2)}.{number(5)}")

    for _ in range(n):
        out, spans = words(0, 6), []
        for _ in range(rng.integers(1, 3)):
            if rng.random() < 0.5:
                s, own = personal()
                kind = next((k for k in (CARD, PHONE) if s[own[0][0]].isdigit() and (len(s) > 14) == (k == CARD)), EMAIL if any(c.isalpha() for c in s) else PHONE)
                weak = kind == PHONE and s[0] not in "+(0" and "." not in s
                cue = pick(*CUES[kind]) + pick("", ":", " :", ".") if rng.random() < (0.95 if weak else 0.5) else word()
                out += " " + pick(cue, cue.capitalize()) + " "
                spans += [(len(out) + a, len(out) + b) for a, b in own]
            else:
                s = alike()
                out += " " + (pick(*AGAINST) if rng.random() < 0.5 else word()) + pick("", ":", " #") + " "
            out += s + pick("", ".", ",", ";", ")") + " " + words(0, 4)
        yield out, spans


# ---------------------------------------------------------------- what margins and thresholds are set on


def calibration_snippets(n: int, rng: np.random.Generator) -> Iterator[Snippet]:
    """Records, logs, tables, signatures and sentences of real words, with personal data and plain numbers in their places."""
    f = Forms(rng)
    pick, number = f.pick, f.number
    first = ("anna", "peter", "li.wei", "m.garcia", "jean-luc", "s_brown", "k.o.schmidt", "noor", "ivan77", "zoë", "o.müller")
    host = ("example", "post-office", "uni-town", "mail.example", "acme", "shop24", "nord", "cafe-lune")
    top = ("com", "org", "net", "de", "fr", "es", "eu", "edu", "info")
    say = ("the parcel was sent on", "see the report of last week", "wir haben das Paket erhalten", "nous avons bien reçu", "el pedido llegó", "as agreed", "for questions", "please note", "bitte beachten", "merci de", "gracias por", "results are below", "the measured values were")

    def address() -> str:
        at, dot = pick(("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" at ", " dot "), (" AT ", " DOT "), ("@", "(dot)"), (" @ ", "."), ("[@]", "."), ("{at}", "{dot}"), ("@", "."))
        return f"{pick(*first)}{at}{pick(*host).replace('.', dot)}{dot}{pick(*top)}"

    def phone() -> str:
        return pick(
            f"0{number(2)} {number(3)} {number(2)} {number(2)}", f"0{number(4)}-{number(5)}", f"0{number(2)}/{number(7)}", f"{number(3)}/{number(3)}-{number(4)}", f"({number(3)}){number(3)}-{number(4)}", f"({number(3)}) {number(3)} {number(4)}", f"0{number(1)}.{number(2)}.{number(2)}.{number(2)}.{number(2)}",
            f"{number(3)}-{number(3)}-{number(4)}", f"00{number(2)}-{number(3)}-{number(6)}", f"0{number(3)} {number(6)}")

    def card() -> str:
        c, s = f.card(int(pick("16", "16", "16", "15")), pick("345", "6", "2")), pick(".", " . ", "/", "–", "  ", "_", ":")
        if len(c) == 15:
            return pick("–", "/", ".").join((c[:4], c[4:10], c[10:]))
        return s.join(c[k : k + 4] for k in range(0, 16, 4))

    def ip() -> str:
        if rng.random() < 0.5:
            return pick("[.]", "[dot]", "(.)").join(str(rng.integers(1, 255)) for _ in range(4))
        h = [f"{rng.integers(1, 65536):x}" for _ in range(8)]
        return pick(":".join(h), ":".join(["2001", "db8", *h[2:]]), f"fe80::{h[1]}:{h[2]}:{h[3]}", f"2001:{h[1]}:{h[2]}::{pick('1', '2', h[3])}")

    own = lambda s: (s, True)
    not_ = lambda s: (s, False)

    def with_data() -> Snippet:
        k = rng.integers(12)
        if k == 0:
            return f.joined(not_(f"{pick(*say)} {pick('write to', 'Kontakt:', 'mailto', 'contact me under', 'Adresse :', '-', '<')} "), own(address()), not_(f"{pick('', '>', '.', ' !')} {pick(*say)}"))
        if k == 1:
            return f.joined(not_("{" + f'"name": "{pick(*first)}", "phone": "'), own(phone()), not_('", "zip": "' + number(5) + '"}'))
        if k == 2:
            return f.joined(not_(f"{pick('Tel', 'Tél', 'Fax', 'Telefon', 'Teléfono', 'Phone', 'Mobile', 'call us')}{pick('.', ':', ' ', '.: ')} "), own(phone()), not_(f"\n{pick(*say)}"))
        if k == 3:
            return f.joined(not_(f"{pick('Visa', 'card', 'Kreditkarte', 'carte', 'tarjeta', 'paid with', 'cc', 'MasterCard no.')}{pick(':', '', ' #')} "), own(card()), not_(f"{pick(' exp ', ' valid thru ', ', ')}{number(2)}/{number(2)}"))
        if k == 4:
            return f.joined(not_(f"{rng.integers(1, 29)} {pick('Jan', 'Mai', 'ago')} {pick('sshd', 'nginx', 'kernel')}: {pick('client', 'from', 'host', 'connection of', 'blocked')} "), own(ip()), not_(f" {pick('port', 'status', 'size')} {number(4)}"))
        if k == 5:
            a, b = f.card(), f.card()
            return f.joined(not_(f"{pick(*say)} "), own(a), not_(" "), own(b), not_(f" {pick(*say)}"))
        if k == 6:
            a = f.card()
            s = pick(" ", "-")
            return f.joined(not_(f"{pick('card', 'account', 'paid')} "), own(s.join(a[i : i + 4] for i in range(0, 16, 4))), not_(f" {number(3)} {pick(*say)}"))
        if k == 7:
            return f.joined(not_(f"{pick(*say)} "), own(f"+{number(2)} {number(3)} {number(7)}"), not_(f" {pick(number(8), f.no_card(), number(6) + ' ' + number(5))} {pick(*say)}"))
        if k == 8:
            return f.joined(not_(f"| {pick(*first)} | "), own(phone()), not_(f" | {number(5)} | "), own(address()), not_(" |"))
        if k == 9:
            return f.joined(not_(f"{pick(*say)}: "), own(address()), not_(f", {pick('tel', 'fax')} "), own(phone()))
        if k == 10:
            return f.joined(not_(f"{pick(*say)} "), own(f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}"), not_(f" {f.no_card()} {pick(*say)}"))
        return f.joined(not_(f"{pick(*say)} "), own(pick(card, ip, address)()), not_(f" {pick(*say)}"))

    def without() -> Snippet:
        y, m, d = rng.integers(1980, 2027), rng.integers(1, 13), rng.integers(1, 29)
        c = f.card(16, "123456789")
        return f.joined(not_(pick(
            f"{y}/{m:02d}/{d:02d} {rng.integers(24):02d}:{rng.integers(60):02d} {pick(*say)}", f"order {number(4)}-{number(7)}-{number(7)}", f"ISBN 3-{number(4)}-{number(4)}-{number(1)}", f"IBAN DE{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}",
            f"{pick(*say)} " + " ".join(f"{rng.integers(1000)}.{rng.integers(10)}" for _ in range(rng.integers(3, 9))), "| " + " | ".join(number(int(rng.integers(1, 6))) for _ in range(6)) + " |", f"x = [{', '.join(number(3) for _ in range(6))}]",
            f"tracking {c[:2]} {c[2:8]} {c[8:]} {pick(*say)}", f"{pick(*say)} {c[:6]}-{c[6:]}", f"population {number(1)} {number(3)} {number(3)} in {y}", f"{number(2)} {number(2)} {number(2)} {number(2)} {number(2)} {number(2)} {number(2)}", f"at {number(2)}.{number(5)}, {number(2)}.{number(5)}",
            "we met at noon dot com was new", f"{pick(*first)} at work. {pick(*say)}", f"meet me at {pick(*host)} on {d}.{m}.{y}", f"foo::bar::baz({number(2)})", f"{rng.integers(24):02d}:{rng.integers(60):02d}:{rng.integers(60):02d}:{number(3)}", f"{number(2)}:{number(2)}:{number(2)}:{number(2)}:{number(2)}:{number(2)}",
            f"section 1.{number(1)}.{number(1)}.{number(1)}.{number(1)} {pick(*say)}", f"{y}-{y + 3}, {number(3)}-{number(3)}, {number(4)}-{number(4)}", f"id={number(10)} {pick(*say)}", f"{number(3)} {number(3)} {number(3)} {number(3)} {number(3)}", f"price 1.{number(3)}.{number(3)},{number(2)}", f"{pick(*say)} {number(16)}", f"+{number(2)} % {pick(*say)}", f"score {number(1)}-{number(1)} {number(2)}-{number(2)}", f"{pick(*say)} {number(4)} {number(4)} {number(4)}")))

    for _ in range(n):
        yield with_data() if rng.random() < 0.5 else without()


# ---------------------------------------------------------------- the model


def rows_of(snippets: Iterator[Snippet]) -> tuple[np.ndarray, list[list[float]], np.ndarray]:
    """(kind, features, personal) of all candidates that overlap no base span."""
    kinds, rows, labels = [], [], []
    for text, spans in snippets:
        for c in candidates(text):
            kinds.append(c[1])
            rows.append(features(text, c))
            labels.append(any(min(b, c[2]) - max(a, c[0]) >= 0.9 * max(b - a, c[2] - c[0]) for a, b in spans))
    return np.array(kinds), rows, np.array(labels, np.float64)


def calibrated(trees: Trees, x: np.ndarray, y: np.ndarray) -> Scorer:
    """Probabilities by a logistic of the margin: Newton steps, halved until the loss falls, on labels drawn in by Platt's rule so that
    separable ones don't drive the scale to infinity."""
    z, n = trees.margin(x), y.sum()
    t = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    loss = lambda w: np.sum(np.logaddexp(0, w[0] * z + w[1]) - t * (w[0] * z + w[1]))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(w[0] * z + w[1])))
        v = p * (1 - p)
        step = np.linalg.solve([[np.sum(v * z * z) + 1e-6, np.sum(v * z)], [np.sum(v * z), np.sum(v) + 1e-6]], [np.sum((p - t) * z), np.sum(p - t)])
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return Scorer(trees, float(w[0]), float(w[1]))


def train(snippets: int = 12_000, seed: int = 11, precision: float = PRECISION) -> Judge:
    """Trees from training snippets; calibration and thresholds from half as many calibration snippets. A kind's threshold is the least
    at which the selected candidates, overlaps resolved, have the precision asked for there."""
    kinds, rows, y = rows_of(training_snippets(snippets, np.random.default_rng(seed)))
    held_snippets = list(calibration_snippets(snippets // 2, np.random.default_rng(seed + 1)))
    held_kinds, held, held_y = rows_of(iter(held_snippets))
    scorers = []
    for mail in (True, False):
        own, other = np.flatnonzero((kinds == EMAIL) == mail), np.flatnonzero((held_kinds == EMAIL) == mail)
        trees = boost(np.array([rows[k] for k in own], np.float64), y[own])
        scorers.append(calibrated(trees, np.array([held[k] for k in other], np.float64), held_y[other]))
    out = Judge(*scorers, (0.0,) * 4)
    kept: list[list[tuple[float, bool]]] = [[], [], [], []]
    for text, spans in held_snippets:
        found = candidates(text)
        if not found:
            continue
        p = out.probabilities(text, found)
        by_span = dict(zip(found, p))
        for s in likeliest(found, p):
            kept[s[1]].append((float(by_span[s]), any(min(b, s[2]) - max(a, s[0]) >= 0.9 * max(b - a, s[2] - s[0]) for a, b in spans)))
    limits = []
    for selected in kept:
        p, right = np.array([x for x, _ in selected]), np.array([x for _, x in selected])
        good = [s for s in np.arange(0.5, 1.0, 0.01) if (p >= s).any() and right[p >= s].mean() >= precision]
        limits.append(round(float(min(good, default=0.99)), 2))
    out.thresholds = tuple(limits)
    return out


if __name__ == "__main__":
    MODEL.write_text(_to_json(train()))
