"""Crawl frontier operators over tables of URLs and pages."""

from __future__ import annotations

import random
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from urllib.parse import urldefrag, urljoin, urlparse

from pyspark.sql import DataFrame, functions as F

from terrasift.functions import text as T


def frontier(urls: DataFrame, tld: str = "") -> DataFrame:
    """(url, visits): normalised, valid, in scope; visits counts how often a URL was entered."""
    u = urls.select(T.clean_url(F.col("url")).alias("url")).where(T.url_ok(F.col("url")))
    return (u.where(T.in_scope(F.col("url"), tld)) if tld else u).groupBy("url").agg(F.count(F.lit(1)).alias("visits"))


def keep_pages(pages: DataFrame, words: tuple = T.CRAWL_WORDS) -> DataFrame:
    """Pages (url, html) whose text holds one of the words and whose path none of the skipped ones, with the file that they are saved as."""
    return pages.where(T.crawl_wanted(T.html_text(F.col("html")), F.col("url"), words)).withColumn("file", T.url_file(F.col("url")))


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """(digest, n): contents that occur more than once."""
    return pages.groupBy(F.md5("html").alias("digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def next_url(found: DataFrame, order: str = "fifo", seed: int = 0, n: int = 1) -> DataFrame:
    """The next n of (url, ord): by arrival, or in seeded random order."""
    by = [F.col("ord")] if order == "fifo" else [F.xxhash64(F.lit(seed), "url")]
    return found.orderBy(*by, "url").limit(n)


class Crawler:
    """One worker over a frontier: first in first out, or seeded random. A URL is fetched once; visits
    count how often it was entered; only URLs that contain tld are in scope."""

    def __init__(self, fetch: Callable[[str], str], tld: str = "", order: str = "fifo", seed: int = 0, limit: int = 1000):
        self.fetch, self.tld, self.order, self.limit = fetch, tld, order, limit
        self.visits: Counter[str] = Counter()
        self._waiting: deque[str] = deque()
        self._random = random.Random(seed)

    def enter(self, url: str) -> bool:
        url = urldefrag(url.strip())[0]
        if urlparse(url).scheme not in ("http", "https") or self.tld not in url:
            return False
        self.visits[url] += 1
        if self.visits[url] > 1:
            return False
        self._waiting.append(url)
        return True

    def __len__(self) -> int:
        return len(self._waiting)

    def _next(self) -> str:
        if self.order == "random":
            self._waiting.rotate(-self._random.randrange(len(self._waiting)))
        return self._waiting.popleft()

    def run(self, seeds: list[str]) -> Iterator[tuple[str, str]]:
        """Yields (url, html); pages that cannot be fetched are passed over."""
        for s in seeds:
            self.enter(s)
        for _ in range(self.limit):
            if not self._waiting:
                return
            url = self._next()
            try:
                html = self.fetch(url)
            except OSError:
                continue
            yield url, html
            for target in re.findall(r'href="([^"]+)"', html):
                self.enter(urljoin(url, target))
