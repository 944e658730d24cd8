"""URL filter (operator 7).

Rules come first: the longest one that fits a URL's host and path decides. Where none fits, unigram Viterbi splits concatenated
host and path names into words, and multinomial naive Bayes over these words decides. Both models are made here from the URLs: word
counts (one a host, so that a host with many pages is one voice), and token counts of URLs whose own words include, or do not include, a
seed word. Every word and token counts: the commonest are dictionaries of a stated size, and those beyond are tables that are joined to the URLs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Words of unwanted sites, and everyday words of host names, that the word model knows beforehand.
SEED_BAD = ("casino", "poker", "bet", "bets", "betting", "slots", "jackpot", "gambling", "pills", "viagra", "pharma", "adult", "porn", "sex", "xxx", "nude", "escort", "spam", "malware", "phishing", "warez", "torrent", "crack", "ads", "adserver", "tracker", "tracking", "loan", "payday")
SEED_PLAIN = ("cheap", "free", "win", "farm", "track", "online", "best", "top", "shop", "store", "news", "blog", "mail", "home", "web", "site", "page", "my", "the", "click", "data", "info", "world", "live", "game", "games", "play", "health", "med", "meds", "book", "food", "city", "school", "learn", "tech", "code", "music", "video", "photo", "art", "x")
SEED_COUNT = 50
#: Words, or tokens, that Python workers hold; all others are joined.
HELD = 50_000
_LETTERS = re.compile(r"[^\W\d_]+|\d+")
_LONGEST = 24


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    host, path = (F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def by_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


@dataclass
class WordModel:
    """Unigram log probabilities; a spelling it does not know costs the more the longer it is. ``rare`` holds what else the URL at hand may need."""

    logs: dict[str, float]
    total: float
    rare: dict[str, float] = field(default_factory=dict)

    def split(self, name: str) -> list[str]:
        """The likeliest words of a run of letters (Viterbi over cut points); long words are cut by the unknown-word rule only."""
        n = len(name)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - _LONGEST), j):
                s = best[i] + self.log(name[i:j])
                if s > best[j]:
                    best[j], back[j] = s, i
        out, j = [], n
        while j:
            out.append(name[back[j] : j])
            j = back[j]
        return out[::-1]

    def log(self, word: str) -> float:
        known = self.logs.get(word)
        if known is None:
            known = self.rare.get(word)
        return known if known is not None else math.log(2 / self.total) - 2.3 * len(word)


def _commonest(counts: DataFrame, first: Sequence[str], held: int) -> tuple[list, DataFrame | None]:
    """Rows of the ``held`` commonest words ``w`` (``first`` before all, ties by name), and a table of the others if there are any."""
    held = max(held, len(first) + 1)
    seed = F.col("w").isin(list(first))
    top = counts.orderBy(seed.desc(), F.desc("n"), "w").limit(held + 1).collect()
    if len(top) <= held:
        return top, None
    last = top[held - 1]
    return top[:held], counts.where(~seed & ((F.col("n") < last["n"]) | ((F.col("n") == last["n"]) & (F.col("w") > last["w"]))))


def word_model(urls: DataFrame, held: int = HELD) -> tuple[WordModel, DataFrame | None]:
    """Counts of letter runs in host labels, one a host, and the seeds; and a table (w, log) of the words that the model does not hold."""
    hosts = urls.select("host").distinct()
    tokens = hosts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("host"), F.lit(r"(\p{L}+)"), 1))).alias("w"))
    words = materialize(tokens.where(F.length("w") <= _LONGEST).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "words")
    top, rest = _commonest(words, SEED_BAD + SEED_PLAIN, held)
    counts = {r["w"]: float(r["n"]) for r in top}
    total = float(words.agg(F.sum("n")).first()[0] or 0) + SEED_COUNT * len(SEED_BAD + SEED_PLAIN) + 1
    for w in SEED_BAD + SEED_PLAIN:
        counts[w] = counts.get(w, 0.0) + SEED_COUNT
    return WordModel({w: math.log(n / total) for w, n in counts.items()}, total), rest and rest.select("w", F.log(F.col("n") / F.lit(total)).alias("log"))


class Segmenter(dict):
    """Words of a letter run; remembers what it has split (bounded)."""

    def __init__(self, model: WordModel):
        super().__init__()
        self.model = model

    def __missing__(self, run: str) -> list[str]:
        if len(self) > 200_000:
            self.clear()
        words = self.model.split(run)
        if len(run) < 64:
            self[run] = words
        return words

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host and, marked apart, of the path; digits become one sign."""
        out = []
        for mark, text in (("", host), ("/", path.lower())):
            for run in _LETTERS.findall(text):
                out += [mark + "0"] if run[0].isdigit() else [mark + w for w in self[run]] if run.isascii() or len(run) < 64 else [mark + run]
        return out


def _with_rare(urls: DataFrame, rest: DataFrame) -> DataFrame:
    """Add ``rare``, those words of ``rest`` that are spelled somewhere in a row's letter runs, to rows (row, host, path, ...)."""

    @F.pandas_udf("array<string>")
    def runs(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([sorted({r for t in (h, p.lower()) for r in _LETTERS.findall(t) if not r[0].isdigit()}) for h, p in zip(hosts, paths, strict=True)], dtype=object)

    @F.pandas_udf("array<string>")
    def spelled(names: pd.Series) -> pd.Series:
        return pd.Series([sorted({x[i:j] for i in range(len(x)) for j in range(i + 1, min(len(x), i + _LONGEST) + 1)}) for x in names], dtype=object)

    runs_of = materialize(urls.select("row", F.explode(runs("host", "path")).alias("run")), "runs")
    known = runs_of.select("run").distinct().select("run", F.explode(spelled("run")).alias("w")).join(rest, "w")
    known = materialize(known.groupBy("run").agg(F.collect_list(F.struct("w", "log")).alias("known")), "known")
    of_row = runs_of.join(known, "run").groupBy("row").agg(F.flatten(F.collect_list("known")).alias("rare"))
    return urls.join(of_row, "row", "left")


def segmented(urls: DataFrame, model: WordModel, rest: DataFrame | None = None) -> DataFrame:
    """Add ``tokens`` to rows (row, host, path, ...)."""

    @F.pandas_udf("array<string>")
    def tokens(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        s = Segmenter(model)
        return pd.Series([s.tokens(h, p) for h, p in zip(hosts, paths, strict=True)], dtype=object)

    @F.pandas_udf("array<string>")
    def tokens_of_all(hosts: pd.Series, paths: pd.Series, words: pd.Series, logs: pd.Series) -> pd.Series:
        s, out = Segmenter(model), []
        for h, p, w, x in zip(hosts, paths, words, logs, strict=True):
            model.rare = {} if w is None else dict(zip(w, x, strict=True))
            out.append(s.tokens(h, p))
        return pd.Series(out, dtype=object)

    if rest is None:
        return urls.withColumn("tokens", tokens("host", "path"))
    return _with_rare(urls, rest).withColumn("tokens", tokens_of_all("host", "path", "rare.w", "rare.log")).drop("rare")


@dataclass
class UrlModel:
    """Log odds of blocking: of a URL at all, and of each token."""

    prior: float
    odds: dict[str, float]


def naive_bayes(rows: DataFrame, seeds: Sequence[str] = SEED_BAD, held: int = HELD) -> tuple[UrlModel, DataFrame | None]:
    """Multinomial naive Bayes with add-one smoothing. A URL counts as bad if a host token is a seed word, else as good.

    Also a table (w, odds) of the tokens that the model does not hold.
    """
    bad = F.arrays_overlap("tokens", F.array(*[F.lit(s) for s in seeds]))
    marked = rows.select("tokens", F.when(bad, 1).otherwise(0).alias("bad"))
    totals = marked.agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens") * F.col("bad")).alias("bad_tokens"), F.sum(F.size("tokens")).alias("tokens")).first()
    if not totals["n"]:
        return UrlModel(-1.0, {}), None
    counts = materialize(marked.select(F.explode("tokens").alias("w"), "bad").groupBy("w").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")), "tokens")
    top, rest = _commonest(counts, seeds, held)
    v = (len(top) if rest is None else counts.count()) + len(seeds)
    good_all, bad_all = totals["tokens"] - totals["bad_tokens"], totals["bad_tokens"]
    odds = {r["w"]: math.log((r["bad"] + 1) / (bad_all + v)) - math.log((r["n"] - r["bad"] + 1) / (good_all + v)) for r in top}
    for s in seeds:
        odds.setdefault(s, math.log((SEED_COUNT + 1) / (bad_all + v)) - math.log(1 / (good_all + v)))
    others = rest and rest.select("w", (F.log((F.col("bad") + 1) / F.lit(bad_all + v)) - F.log((F.col("n") - F.col("bad") + 1) / F.lit(good_all + v))).alias("odds"))
    return UrlModel(math.log((totals["bad"] + 1) / (totals["n"] - totals["bad"] + 1)), odds), others


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, held: int = HELD) -> DataFrame:
    """(page_id, host, path, rule, verdict, tokens, log_odds) for every row of ``pages`` (columns page_id and url).

    A null url, or one without ``://``, has empty parts, fits no rule and is judged by the prior alone. Rows that repeat get equal rows;
    an empty table gives no rows; other columns are ignored.
    """
    ship(pages.sparkSession)
    host, path = url_parts("url")
    urls = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    words, rest = word_model(urls, held)
    if rest is not None:
        urls = materialize(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    rows = segmented(urls, words, rest)
    rows = materialize(rows if rest is not None else rows.withColumn("row", F.monotonically_increasing_id()), "segmented")
    model, rest = naive_bayes(rows, held=held)

    @F.pandas_udf("double")
    def log_odds(tokens: pd.Series) -> pd.Series:
        get = model.odds.get
        return pd.Series([model.prior + sum(get(w, 0.0) for w in t) for t in tokens], dtype="float64")

    @F.pandas_udf("array<string>")
    def not_held(tokens: pd.Series) -> pd.Series:
        return pd.Series([[w for w in t if w not in model.odds] for t in tokens], dtype=object)

    scored = log_odds("tokens")
    if rest is not None:
        more = rows.select("row", F.explode(not_held("tokens")).alias("w")).join(rest, "w").groupBy("row").agg(F.sum("odds").alias("more"))
        rows = materialize(rows.join(more, "row", "left"), "more")
        scored += F.coalesce("more", F.lit(0.0))
    judged = rows.withColumns({"log_odds": scored, "by_rule": by_rules(F.col("host"), F.col("path"), rules)})
    own = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", own).alias("verdict"), "tokens", "log_odds")
