"""URL filter: logistic regression on hashed character n-grams of host and path, from a small labelled table."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

BITS = 15
SLOTS = 1 << BITS
_MUL = np.uint64(0x9E3779B97F4A7C15)

_BAD = """casino-royal online-casino casino-win slots-casino poker-stars lucky-poker free-bets sports-bet betting-tips bet-now jackpot-spin
cheap-pills buy-pills pills-shop viagra-store pharmacy-deals cialis-cheap adult-x adult-video xxx-tube porn-hub sexy-cams hot-cams escort-girls nude-pics
spam-farm link-farm seo-spam content-farm click-farm traffic-bot ads-track ad-tracker adserver-track popup-ads track-click ads-network malware-drop phish-login
free-crack warez-download torrent-crack payday-loans quick-loans get-rich-fast crypto-doubler fake-watches replica-bags win-prize free-iphone""".split()
_GOOD = """library science-news university gardening history cooking weather museum garden-notes cityhall openbooks school-board astronomy physics math-notes
travel-diary mountain river-walks birds recipes bakery music-theory theatre painting architecture parliament law-review hospital health-guide nursing
farmers-market farming fieldnotes adultery-law adult-learning betty-bakes better-homes alphabet tracking-birds railway-tracks additive-design advice
pillar pillow-shop spamalot-theatre winter-sports window-repair castle cashmere thinking weather-track there within information national the-other nation
rather other weaver research document archive blogging reading letters village harvest orchard pottery engineer teacher student""".split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 to block)."""
    out = []
    tails = ["/en/{}.html", "/de/{}?utm_source=feed", "/{}/", "/fr/{}?page=2&ref=x", "/es/{}#top", "/en/{}"]
    heads = ["", "www.", "m.", "blog.", "shop.", ""]
    for label, names in ((1, _BAD), (0, _GOOD)):
        for i, name in enumerate(names):
            for j in range(3):
                k = i * 3 + j
                out.append((f"http{'s' * (k % 2)}://{heads[k % 6]}{name}.example.{('com', 'net', 'org')[k // 2 % 3]}{tails[k * 7 % 6].format(1000 + 37 * k)}", label))
            place = ("articles", "posts", "item", "p")[i % 4]
            out.append((f"https://{('host', 'site', 'pages', 'mirror')[i % 4]}.example.org/{place}/{name}/{i}", label))
    return out


_SPLIT = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")


def parts(url: str) -> tuple[str, str]:
    """Host (lower case, without user and port) and path (digits as 0)."""
    m = _SPLIT.match(url)
    host, path = m.groups() if m else ("", url)
    host = host.rpartition("@")[2].lower()
    return re.sub(r":\d*$", "", host), re.sub(r"\d+", "0", path.lower())


def slots_of(url: str) -> np.ndarray:
    """Slots of the distinct 3- to 6-grams of host and path, each kind apart."""
    out = []
    for kind, s in enumerate(parts(url)):
        c = np.frombuffer(f"^{s}$".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint64) + np.uint64(1)
        h = np.full(len(c), kind + 1, np.uint64)
        for n in range(1, 7):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * _MUL
            h ^= h >> np.uint64(31)
            if n >= 3:
                out.append((h * _MUL) >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


def train(table: list[tuple[str, int]], l2: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights by slot and the bias, by full-batch gradient steps with momentum; rows count once however often they occur."""
    table = sorted({(u, int(y)) for u, y in table if u is not None and y is not None})
    if not table:
        return np.zeros(SLOTS), 0.0
    lists = [slots_of(u) for u, _ in table]
    y = np.array([k for _, k in table], float)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = np.concatenate(lists)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(lists))))
    w, b, vw, vb = np.zeros(SLOTS), 0.0, np.zeros(SLOTS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights=w[at], minlength=len(y)) * scale + b)))
        g = (p - y) / len(y)
        vw = 0.9 * vw - 8.0 * (np.bincount(at, weights=(g * scale)[row], minlength=SLOTS) + l2 * w)
        vb = 0.9 * vb - 1.0 * g.sum()
        w, b = w + vw, b + vb
    return w, b


def url_score(url: Column, model: tuple[np.ndarray, float]) -> Column:
    """Probability that a URL is to be blocked; null for null or empty."""
    w, b = model[0].astype(np.float32), model[1]

    @arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out, seen = [], {}
        for u in column.to_pylist():
            if not u:
                out.append(None)
                continue
            key = parts(u)
            if key not in seen:
                at = slots_of(u)
                z = float(w[at].sum()) / max(1, len(at)) ** 0.5 + b
                seen[key] = round(float(1 / (1 + np.exp(-z))), 6)
            out.append(seen[key])
        return pa.array(out, pa.float64())

    return score(url)


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, score, blocked) for every row.

    A null or empty URL has score null and isn't blocked. A string that isn't a URL is scored as a path. Repeated rows are scored alike, rows with a null id like any other. URLs of any length count whole. An empty table gives an empty result. Only id and URL are read. ``labelled`` is a small table of (url, 0 or 1), by default the built-in one.
    """
    s = url_score(F.col(url), train(labelled_urls() if labelled is None else labelled))
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), s.alias("score")).select("page_id", "url", "score", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("blocked"))
