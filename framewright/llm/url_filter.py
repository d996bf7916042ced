"""URL filter: longest matching rule, else logistic regression on hashed character n-grams.

The model sees n-grams of 3 to 5 characters of the host's labels and of the path, hashed to a
fixed number of weights, and is trained by gradient descent on the driver from a small labelled
table (labelled() by default, some hundred URLs: bounded). Scoring hashes in Arrow batches.

Null and empty urls, or those without "://": host and path are empty; no rule fits and the model, which
then has only its bias, allows it. Ties between rules of equal length cannot occur, as equal length
and equal fit mean equal rules. Very long urls are read whole. Repeated rows are judged each. Empty
table: no rows. Other columns, also those named like an output column, are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import common

#: (host, path, verdict); an empty path fits every path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BITS = 14

#: Names of sites to block, by what blocklists usually cover: gambling, adult, medicine, trackers, link spam, fraud, pirated goods.
_BLOCKED = (
    "onlinecasino royalcasino casinobonus mobilecasino pokerroom videopoker slotmachines jackpotslots roulettewheel blackjacktable sportsbetting livebetting betting-odds bingohall lottowinner "
    "adultvideos adult-movies xxxmovies porntube hardcoreporn sexcams livesex nudepics escortgirls hookuptonight adultchat webcamgirls eroticstories "
    "buyviagra genericcialis pillstore pillsdiscount noprescription-pills dietpills weightlosspills steroidshop painkillers-cheap cheapmeds onlinepharmacy-rx "
    "adserver adtracker clicktracker trackingpixel pixeltrack bannerads popupads popunder adnetwork adclicks affiliate-clicks "
    "spamlinks spammer bulkspam linkfarm backlinkfarm articlefarm linkexchange seo-backlinks massmailer emailblast "
    "verify-account-login secure-bank-update freegiftcard claim-your-prize winfreephone freemoney-now getrichquick fastcash paydayloan instantloans doublebitcoin "
    "crackedsoftware serialkeys keygenerator warezdownload replicawatches fakehandbags fakepassports counterfeitcash"
).split()
#: Names of ordinary sites.
_ALLOWED = (
    "encyclopedia dictionary thesaurus nationallibrary citylibrary universitypress openuniversity highschool kindergarten mathematics physicsforum chemistrylab biologynotes geography astronomy "
    "historymuseum artgallery sciencecentre botanicgarden zoological aquarium planetarium theatre orchestra cinema literature poetry shortstories bookreviews "
    "dailynews eveningherald morningpost localradio publictelevision weatherservice farmersalmanac economist statistics parliament citycouncil taxoffice postoffice embassy courthouse "
    "hospital dentist veterinarian physiotherapy nutrition firstaid fitnessclub yogastudio footballclub swimming cycling marathon chesssociety gardening woodworking knitting photography "
    "recipes bakery vegetarian restaurant coffeehouse brewery vineyard grocery farmersmarket hardwarestore bicycleshop furniture stationery toyshop shoemaker tailor jeweller "
    "trainstation railways airport ferrytimetable hiking mountaineering campsite lighthouse nationalpark coastline riverside islandtours hotelguide roadmap cartography "
    "python-docs opensource compilers database networking webstandards linuxusers developer tutorials mailinglist documentation research archives journal conference laboratory institute foundation "
    "education teaching learning students teachers parents children grandparents neighbours community volunteers charity church monastery heritage genealogy folklore translation linguistics grammar"
).split()


def labelled() -> list[tuple[str, int]]:
    """A small labelled table (url, 1: block) from general knowledge, with the same domains and paths in both classes."""
    ends, paths = (".com", ".org", ".info", ".co.uk", ".de", ".fr", ".es", ".it", ".io"), ("/", "", "/index.php?id=7", "/about", "/2019/05/welcome", "/category/item-12", "/login", "/a/b/c.htm")
    blank = [("", 0)] * 8  # a url without host and path is no ground to block
    return blank + [(f"https://{name}{ends[(i + 4 * k) % len(ends)]}{paths[(i + 3 * k) % len(paths)]}", y) for y, names in ((1, _BLOCKED), (0, _ALLOWED)) for i, name in enumerate(names) for k in range(2)]


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    path = tail[: min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def grams(host: str, path: str, bits: int = BITS) -> np.ndarray:
    """Distinct hashed n-grams of 3 to 5 bytes, those of host and path apart."""
    out = set()
    for mark, s in ((b"h", b"^" + host.encode() + b"$"), (b"p", b"^" + path.encode() + b"$")):
        for n in (3, 4, 5):
            out.update(zlib.crc32(mark + s[i : i + n]) & (1 << bits) - 1 for i in range(len(s) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def train(table: list[tuple[str, int]], bits: int = BITS, epochs: int = 300, rate: float = 1.0, decay: float = 1e-3) -> np.ndarray:
    """Weights by full-batch gradient descent; the last one is the bias. A gram counts once, over the root of their number; both classes weigh the same."""
    rows = [grams(*parts(u), bits) for u, _ in table]
    y = np.array([v for _, v in table], float)
    w = np.zeros((1 << bits) + 1)
    if not table:
        return w
    flat, which = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(which, minlength=len(rows))))
    for _ in range(epochs):
        z = np.bincount(which, w[flat], len(rows)) * scale + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) * share
        w[:-1] -= rate * 10 * (np.bincount(flat, (g * scale)[which], 1 << bits) + decay * w[:-1] / 10)
        w[-1] -= rate * g.sum()
    return w


def scored(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", url_col: str = "url", bits: int = BITS) -> DataFrame:
    """id, url, probability that the url is to be blocked. The weights are 2**bits numbers."""
    held = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for b in batches:
            out = []
            for u in b.column(1).to_pylist():
                g = grams(*parts(u), bits)
                out.append(1 / (1 + np.exp(-(w[g].sum() / np.sqrt(max(1, len(g))) + w[-1]))))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["page_id", "url", "p_block"])

    return pages.select(F.col(id_col), F.col(url_col).cast("string")).mapInArrow(common.trimmed(run), f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, p_block double")


def host_path(url: Column) -> tuple[Column, Column]:
    """The same as parts(), as columns."""
    at = F.position(F.lit("://"), url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules=RULES, table: list[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, p_block. Rules are a short list, longest (host, then path) first."""
    out = scored(pages, train(labelled() if table is None else table), id_col, url_col)
    host, path = host_path(F.col("url"))
    out = out.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "p_block")
