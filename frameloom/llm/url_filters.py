"""URL filters: rules, then host word segmentation and multinomial naive Bayes.

A rule is a host and a path; it fits a url whose host is the rule's or a subdomain of it and whose path starts with the rule's,
and the longest fitting rule decides. Where none fits, the host's and path's runs of letters are split into words by a unigram
Viterbi search, and a multinomial naive Bayes model over the words blocks or allows.

Null urls and urls without "://" have empty host and path, no words, and are allowed; whole urls are read; among rules of equal
length the first wins; repeated rows each get their row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The rules of the query, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled words that the model is trained on, by topic.
TRAIN = {
    "block": (
        "casino casinos poker slots slot roulette blackjack jackpot bet bets betting gamble gambling wager bingo lottery lotto win winner wins free spins bonus odds",
        "adult porn sex xxx nude naked cam cams escort escorts erotic hot milf fetish hentai dating hookup",
        "pills pill cheap viagra cialis pharmacy pharma drugs meds rx tramadol steroids weight loss diet",
        "spam farm link links seo backlinks clicks click bait traffic exchange bulk mail scam fraud fake replica replicas rolex",
        "ads ad adserver advert adverts banner banners popup popups track tracker trackers tracking pixel affiliate doubleclick analytics beacon counter sponsor promo",
        "phishing malware virus crack cracks keygen warez torrent torrents pirate hack hacked hacks payday loan loans cash fast money rich quick earn crypto giveaway prize prizes",
    ),
    "allow": (
        "news daily times post press journal gazette herald world local politics sport sports weather business economy opinion",
        "blog article articles story stories guide guides wiki docs documentation manual help support faq about contact home page index",
        "science research university college school academy library museum institute education learn course courses student history art culture music film book books review reviews",
        "health hospital clinic doctor medicine family garden kitchen recipe recipes food cooking travel city tour hotel map maps park nature",
        "code software developer developers data open source project projects forum community group api cloud tech technology computer mobile",
        "shop store market product products service services company office work job jobs team house home car cars energy water green",
    ),
}
#: Words that only help to split names; they speak for neither class.
NEUTRAL = "my your our the best top new all get online official site web world town land life live plus pro hub zone club center central united national international american express house street first super mega real easy smart".split()
#: Chances of the classes before any word, the count added to every word's, and an unknown word's chance: its first letter's, and
#: the logarithm by which it falls with each further letter.
PRIOR, SMOOTHING, UNKNOWN, PER_LETTER = {"block": 0.3, "allow": 0.7}, 0.5, 1e-6, 1.2
MAX_WORD = 24
_LETTERS = re.compile(r"[a-z]+")


class UrlModel:
    """Unigram word chances for segmentation, and naive Bayes weights, both counted on the labelled words."""

    def __init__(self, train: dict[str, tuple[str, ...]] | None = None):
        words = {label: [w for line in lines for w in line.split()] for label, lines in (train or TRAIN).items()}
        every = Counter(w for ws in words.values() for w in ws)
        whole = every + Counter(NEUTRAL)
        total = sum(whole.values())
        self.chance = {w: math.log(c / total) for w, c in whole.items()}
        self.prior = math.log(PRIOR["block"] / PRIOR["allow"])
        counts = {label: Counter(ws) for label, ws in words.items()}
        size = {label: len(ws) + SMOOTHING * len(every) for label, ws in words.items()}
        self.weight = {w: math.log((counts["block"][w] + SMOOTHING) / size["block"]) - math.log((counts["allow"][w] + SMOOTHING) / size["allow"]) for w in every}
        self.known: dict[str, list[str]] = {}

    def segment(self, run: str) -> list[str]:
        """The likeliest words of a run of letters; an unknown word's chance falls with each letter."""
        if run in self.chance:
            return [run]
        if (words := self.known.get(run)) is not None:
            return words
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - MAX_WORD), end):
                word = run[start:end]
                score = best[start] + self.chance.get(word, math.log(UNKNOWN) - (len(word) - 1) * PER_LETTER)
                if score > best[end]:
                    best[end], back[end] = score, start
        words, end = [], len(run)
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        words.reverse()
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[run] = words
        return words

    def score(self, host: str, path: str) -> float:
        """Log odds of block; words that no class has seen, and one-letter pieces cut from longer runs, say nothing."""
        total = self.prior
        for run in _LETTERS.findall(host) + _LETTERS.findall(path.lower()):
            for word in self.segment(run):
                if len(word) > 2 or word == run:
                    total += self.weight.get(word, 0.0)
        return total


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), host), path


def fitting_rule(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(verdict, rule as text) of the longest rule that fits."""
    fits = [(v, h + p) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[1]), default=None)


def judge_urls(pages: DataFrame, id: str = "page_id", url: str = "url", rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """``id, host, path, rule, verdict, score`` (log odds of block by the model) of every row."""
    model = model or UrlModel()
    rules = tuple(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u in batch.column(1).to_pylist():
                host, path = split_url(u)
                rule, score = fitting_rule(host, path, rules), model.score(host, path)
                rows.append((host, path, rule and rule[1], rule[0] if rule else "block" if score > 0 else "allow", score))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.float64())], [id, "host", "path", "rule", "verdict", "score"])

    return pages.select(id, F.col(url).cast("string").alias("url_")).mapInArrow(judge, f"`{id}` {pages.schema[id].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
