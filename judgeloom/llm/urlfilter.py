"""URL judgement: explicit rules first, then logistic regression on hashed character n-grams.

Parsing and rules are column expressions. The model is trained on the driver from a small labelled URL
table (LABELLED, or any list of (url, blocked)); its weights are one array of BUCKETS floats, which
bounds what is shipped to the workers.

Cases: a null url, or one without ``://``, has an empty host and path and is judged by the model's
prior, which allows it; very long urls are judged whole; repeated rows are judged alike; ties between
rules of one length go to the first in text order; an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
ORDERS = (3, 4, 5)

#: (verdict, host, path prefix); the longest that fits a url decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The small labelled URL table: hosts and paths of unwanted kinds (gambling, drugs, sex, link farms, trackers, loans, counterfeits, malware) and of wanted ones.
BLOCKED_URLS = """
http://grand-casino-games.test/roulette  http://royalcasino.test/jackpot  http://casinos-online.test/register  http://livecasino24.test/blackjack  http://slots-jackpot.test/spin  http://poker-room.test/tournament
http://sportsbets.test/odds  http://bets-today.test/tips  http://betting-bonus.test/deposit  http://freespins.test/bonus  http://bingo-lottery.test/tickets  http://winner-lottery.test/claim-prize
http://pills-pharmacy.test/order  http://genericpills.test/viagra  http://cheapmeds.test/cialis  http://pharmacy-without-prescription.test/tramadol  http://diet-pills.test/buy-now  http://steroids-shop.test/cart
http://adult-dating.test/join  http://adultvideos.test/free  http://xxx-cams.test/live  http://porn-tube.test/watch  http://sexchat.test/adult  http://escorts-adult.test/photos
http://spam-mailer.test/bulk  http://backlinks-spam.test/order  http://linkfarm.test/exchange  http://seo-linkfarm.test/directory  http://bulk-spam-lists.test/emails  http://doorway-farm.test/keywords
http://adserver.test/banner  http://ads-network.test/impression  http://popup-ads.test/serve  http://tracker-pixel.test/collect  http://clicktracking.test/redirect  http://ad-tracking.test/beacon  http://adtrack.test/event
http://payday-loan.test/apply  http://instant-cash-loans.test/approved  http://free-money.test/survey  http://free-giftcards.test/claim  http://replica-watches.test/rolex  http://fake-handbags.test/sale
http://warez-downloads.test/crack  http://keygen-serials.test/download  http://free-iphone.test/winner  http://download-codec.test/setup.exe  http://miracle-weightloss.test/trial  http://work-from-home-cash.test/signup
"""
ALLOWED_URLS = """
http://news.test/politics/today  http://www.library.test/catalogue  http://university.test/research  http://gardening.test/2020/tomatoes  http://daily-press.test/opinion/column  http://www.observer.test/world
http://weather.test/forecast  http://museum.test/exhibitions  http://docs.software.test/api/index.html  http://www.recipes.test/soup  http://cooking.test/bread  http://www.restaurant-guide.test/review
http://wiki.test/History  http://school.test/classes/9  http://www.theatre.test/programme.html  http://thinking.test/essays?page=2  http://blog.letters.test/2019/notes  http://the-reader.test/books
http://city-council.test/minutes  http://www.railway.test/timetable  http://hospital.test/departments/heart  http://parliament.test/debates/77.html  http://www.court.test/decisions  http://ministry.test/press
http://woodwork.test/joints  http://www.bookshop.test/poetry  http://radio.test/stations/12/  http://m.concerts.test/spring  http://www.gallery.test/painters  http://orchestra.test/season
http://science-journal.test/articles/1  http://health.test/heart  http://www.travel-notes.test/rome  http://astronomy.test/stars  http://mathematics.test/theorems  http://www.biology.test/cells
http://maps.test/valley  http://language.test/grammar  http://mountain-hut.test/route  http://www.bakery.test/opening-hours  http://farmers-market.test/apples  http://track-and-field.test/results
http://book-club.test/authors  http://music-school.test/piano  http://forum.cycling.test/thread/12  http://www.chemistry.test/elements  http://history.test/romans  http://dictionary.test/word  http://archive.test/1998/letters
"""
LABELLED = [(u, 1) for u in BLOCKED_URLS.split()] + [(u, 0) for u in ALLOWED_URLS.split()]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://``."""
    take = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(take(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), take(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def grams(host: str, path: str) -> list[int]:
    """Buckets of the character n-grams of host and path, each part in its own space."""
    out = []
    for part, space in (("^" + host + "$", 0), (path, 1)):
        raw = part.encode()
        out += [zlib.crc32(raw[i : i + n], space) % BUCKETS for n in ORDERS for i in range(len(raw) - n + 1)]
    return out


def _split(url: str) -> tuple[str, str]:
    _, sep, rest = url.partition("://")
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    return (host.lower(), tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]) if sep else ("", "")


def train(labelled=LABELLED, steps: int = 500, rate: float = 4.0, l2: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch gradient descent over the labelled urls."""
    x = np.zeros((len(labelled), BUCKETS), np.float64)
    for i, (url, _) in enumerate(labelled):
        ids = grams(*_split(url))
        np.add.at(x[i], ids, 1 / max(1, len(ids)) ** 0.5)
    y = np.array([b for _, b in labelled], np.float64)
    w, b = np.zeros(BUCKETS), -1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ e / len(y) + l2 * w)
        b -= 0.1 * rate * e.mean()
    return w.astype(np.float32), float(b)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability that the url is unwanted)."""
    weights, bias = train(labelled)
    host, path = host_path(F.col(f"`{url_col}`").cast("string"))
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            p = []
            for h, t in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                ids = grams(h, t)
                p.append(float(1 / (1 + np.exp(-(weights[ids].sum(dtype=np.float64) / max(1, len(ids)) ** 0.5 + bias)))))
            yield pa.record_batch([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "score"])

    scored = source.mapInArrow(score, f"page_id {source.schema['page_id'].dataType.simpleString()}, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
