"""Two short streams of our own, and what the profit query gives for them by a plain fold.

Two lines of each stream arrive a second. In pairs they cover: one key and zero sums while windows start up; the same key again and a new
one, profit and loss; checkouts without an ad; keys that don't match; the latest event on either side, and sums across slides; sums inside a
slide, with fractions; and keys that only keep the clock moving while windows drain.
"""

START_MS = 1_700_000_000_000
SLIDES = 5
EARLY, LATE, LAST = 1_650_000_001_000, 1_650_000_002_000, 1_650_000_003_000

ADS = [
    f"21,5,0.0,{EARLY}",
    f"21,5,0.0,{EARLY}",
    f"21,6,3.0,{EARLY}",
    f"22,6,4.5,{EARLY}",
    f"0,7,2.0,{EARLY}",
    f"0,7,1.0,{EARLY}",
    f"23,8,2.0,{EARLY}",
    f"24,8,3.0,{EARLY}",
    f"31,9,1.5,{LATE}",
    f"32,9,2.5,{EARLY}",
    f"31,9,1.5,{EARLY}",
    f"32,9,2.5,{LAST}",
    f"33,4,0.5,{EARLY}",
    f"33,4,1.25,{EARLY}",
    *[f"0,0,0.0,{EARLY}"] * 10,
    f"40,0,0.0,{EARLY}",
    f"40,0,0.0,{EARLY}",
]
CHECKOUTS = [
    f"1,5,21,0.0,{EARLY}",
    f"2,5,21,0.0,{EARLY}",
    f"3,6,21,5.0,{EARLY}",
    f"4,6,22,2.5,{EARLY}",
    f"5,7,0,4.0,{EARLY}",
    f"6,7,0,3.0,{EARLY}",
    f"7,8,25,4.0,{EARLY}",
    f"8,8,26,3.0,{EARLY}",
    f"9,9,31,3.5,{EARLY}",
    f"10,9,32,1.5,{LATE}",
    f"11,9,31,3.5,{EARLY}",
    f"12,9,32,1.5,{LATE}",
    f"13,4,33,1.25,{EARLY}",
    f"14,4,33,2.0,{EARLY}",
    *[f"0,0,0,0.0,{EARLY}"] * 10,
    f"15,0,41,0.0,{EARLY}",
    f"16,0,41,0.0,{EARLY}",
]


def fold() -> list[tuple[int, int, float, int, int]]:
    """(window, ad, profit, latest event time, ads), sorted. Window w is the slides w - 4 to w, slide 1 being the first second."""
    out = []
    for window in range(1, len(ADS) // 2 + SLIDES):
        within = lambda k: window - SLIDES < k // 2 + 1 <= window
        bought = [x.split(",") for k, x in enumerate(ADS) if within(k)]
        sold = [x.split(",") for k, x in enumerate(CHECKOUTS) if within(k)]
        for ad in {int(a[0]) for a in bought} & {int(c[2]) for c in sold if c[2] != "0"}:
            own, of = [a for a in bought if int(a[0]) == ad], [c for c in sold if int(c[2]) == ad]
            profit = sum(float(c[3]) for c in of) - sum(float(a[2]) for a in own)
            out.append((window, ad, profit, max(int(x[-1]) for x in own + of), len(own)))
    return sorted(out)


ROWS = fold()
