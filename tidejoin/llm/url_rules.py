"""URL rules whose blocks reach the aliases of a page: redirects and canonical links make classes of URLs.

Only DataFrame functions are used.  Pages give edges by ``<link rel=canonical>`` and by
``<meta http-equiv=refresh>``; a table of observed redirects may add more.  Connected
components of these edges (alternating star contractions) are the classes of equivalent
URLs.  A URL that a rule blocks blocks its class; a page with a rule of its own keeps that
rule's verdict, so an explicit allow comes before a block that was handed on.

A URL's node is its host in lower case, its path (``/`` if empty) and its query; scheme and
fragment don't tell URLs apart.  A null URL, or one without ``://``, has empty host and
path, no node, and is allowed; one with an empty path takes no block over if its node is allowed.  Repeated rows and URLs are judged alike; null html has no
links; links to the page itself, to no web address or with an empty target are none.
Character references in targets are decoded (numeric ones and the five names of markup),
relative targets are resolved against the page's ``<base>`` or URL.  Comments and the texts
of scripts, styles, titles and text fields hold no tags.  Empty tables give none.  Other columns of
``pages`` are kept, whatever their names, but for those that the operator returns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, scratch, written
from .components import components

#: Rules are an expression over each URL; a longer list is refused.
MOST_RULES = 2000
#: Parts into which the pages of one URL are dealt to meet their class.
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {self.verdict!r}")

    @property
    def text(self) -> str:
        return self.host + self.path


def parsed(lines: list[str]) -> list[Rule]:
    """Rules from lines like ``block example.org/es/``: verdict, then host, then path from its first slash."""
    out = []
    for line in lines:
        verdict, _, where = line.partition(" ")
        host, slash, path = where.strip().partition("/")
        out.append(Rule(verdict, host.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})), slash + path))
    return out


def _lower(c: Column) -> Column:
    """A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL without scheme and fragment; null if there is no ``://``."""
    path = path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; of equal rules one that allows; null without any."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules, not {len(rules)}")
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        one = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


# Each alternative ends with the text, so that no beginning is read twice, and repeats without going back.
_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|title|textarea|xmp|iframe|noembed|noframes)\b.*?(?:</\1\b|\z)|<(?:link|meta|base)(?=[\s/])" + r"""[^>"']*+(?:(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))[^>"']*+)*+(?:>|\z)"""
_ATTRIBUTE = r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?"""
_NAMES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def decoded(c: Column) -> Column:
    """Numeric character references, then the five names; others stay."""
    part = F.split(c, "(?=&#)")
    number = lambda x: F.when(x.rlike(r"^&#[0-9]{1,7};"), F.regexp_extract(x, "^&#([0-9]+);", 1).cast("long")).when(x.rlike("^&#[xX][0-9A-Fa-f]{1,6};"), F.conv(F.regexp_extract(x, "^&#[xX]([0-9A-Fa-f]+);", 1), 16, 10).cast("long"))
    good = lambda n: ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))
    each = F.transform(part, lambda x: F.when(good(number(x)), F.concat(F.decode(F.unhex(F.lpad(F.hex(number(x)), 8, "0")), "UTF-32"), F.regexp_replace(x, "^&#[0-9A-Za-z]+;", ""))).otherwise(x))
    out = F.array_join(each, "")
    for name, char in _NAMES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def _attribute(tag: Column, name: str) -> Column:
    """The first attribute of that name, without quotes and surrounding space; empty if it has no value."""
    head = F.regexp_replace(tag, "^<[A-Za-z]+", "")
    own = F.filter(F.regexp_extract_all(head, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, _ATTRIBUTE, 1)) == name)
    value = F.regexp_extract(F.get(own, F.lit(0)), _ATTRIBUTE, 2)
    return F.trim(decoded(F.regexp_replace(value, r"""^["']|["']$""", "")))


def resolved(target: Column, base: Column) -> Column:
    """A target as an address with ``://``, relative ones against ``base``; null for what is none on the web."""
    root = F.concat(F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    plain, tail = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)?", 1)
    here = path_of(base)
    folder = F.regexp_extract(F.when(here == "", "/").otherwise(here), r"(?s)^(.*/)", 1)
    joined = F.when(F.startswith(plain, F.lit("/")), plain).otherwise(F.concat(folder, plain))
    # each ".." takes the segment before it; a last "." or ".." leaves the folder
    parts = F.split(joined, "/")
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    clean = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    clean = F.concat(F.lit("/"), F.array_join(clean, "/"), F.when((F.size(clean) > 0) & F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    relative = F.when(plain == "", F.concat(root, here, tail)).otherwise(F.concat(root, clean, tail))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")) & F.contains(base, F.lit("://")), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (target == "") | F.startswith(target, F.lit("#")), None)
        .when(F.contains(base, F.lit("://")), relative)
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``source, target, kind``: what canonical links and refreshes of each page's whole html lead to."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    # a tag that counts has one of these words; others need no search for tags
    rows = pages.select(url.alias("source"), html.alias("html")).where(F.contains("source", F.lit("://")) & F.col("html").rlike("(?i)canonical|refresh"))
    tags = F.filter(F.regexp_extract_all("html", F.lit(_MARKUP), F.lit(0)), lambda t: t.rlike("(?i)^<(?:link|meta|base)"))
    # A column for each step, and a written table before any condition on them: expressions that hold one another, or
    # that a condition carries down to the scan, would be written out again and again.
    rows = rows.select("source", tags.alias("tags"))
    rows = rows.select("source", "tags", F.get(F.filter("tags", lambda t: t.rlike("(?i)^<base")), F.lit(0)).alias("base"))
    rows = rows.withColumn("base", _attribute(F.col("base"), "href"))
    rows = rows.withColumn("base", resolved(F.col("base"), F.col("source")))
    rows = rows.select("source", F.coalesce("base", "source").alias("base"), F.explode("tags").alias("tag"))
    rows = rows.withColumn("kind", F.when(F.col("tag").rlike("(?i)^<link"), "canonical").when(F.col("tag").rlike("(?i)^<meta"), "refresh"))
    rows = rows.withColumns({"word": _attribute(F.col("tag"), "rel"), "equiv": _attribute(F.col("tag"), "http-equiv"), "href": _attribute(F.col("tag"), "href"), "content": _attribute(F.col("tag"), "content")})
    rows = written(rows.drop("tag"), "link-tags")
    canonical = (F.col("kind") == "canonical") & F.array_contains(F.split(F.lower("word"), r"\s+"), "canonical")
    refresh = (F.col("kind") == "refresh") & (F.lower("equiv") == "refresh")
    goal = F.trim(F.regexp_replace(F.regexp_extract("content", r"(?is)^[0-9.\s]*[;,]\s*(?:url\s*=)?\s*(.*)$", 1), r"""^["']|["'].*$""", ""))
    rows = rows.where(canonical | refresh).select("source", "base", "kind", F.when(F.col("kind") == "canonical", F.col("href")).otherwise(goal).alias("to"))
    found = written(rows.select("source", resolved(F.col("to"), F.col("base")).alias("target"), "kind"), "links")
    return found.where("target is not null")


def aliases(links: DataFrame) -> DataFrame:
    """``node, class``: the URLs that links join; the class is named by its least node.  Written in the shared folder."""
    ends = links.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b")
    found = components(ends, "a", "b")
    return found.select("node", F.col("component").alias("class")).unionByName(found.select(F.col("component").alias("node"), F.col("component").alias("class")).distinct())


def judged(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``, and ``reason``: rule, alias (a block from the class) or none.

    ``redirects``: ``source, target``, further edges.
    """
    url = F.col("url").cast("string")
    with scratch(pages.sparkSession) as keep:
        links = page_links(pages)
        if redirects is not None:
            links = links.select("source", "target").unionByName(redirects.select("source", "target"))
        found = written(aliases(links), "aliases")
        # the rules of all URLs of a class count, those that no page has included
        node = F.concat(F.lit("x://"), "node")
        own = found.withColumn("_rule", rule_of(host_of(node), path_of(node), rules))
        blocked = own.where("_rule.verdict = 'block'").select("class").distinct()
        # URLs that a rule allows take no block over
        taken = written(own.where("_rule is null or _rule.verdict = 'block'").join(blocked, "class", "left_semi").select(F.col("node").alias("_node")), "blocked-aliases")
        keep.append(taken)
    few = bounded(taken, 100_000)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "reason")]
    key, own, hit, salt, part, node = (_free(n, pages.columns) for n in ("key", "own", "hit", "salt", "part", "node"))
    rows = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias(key))
    rows = rows.withColumn(own, rule_of(F.col("host"), F.col("path"), rules))
    # pages that need no look-up are dealt all over, a hot URL in parts
    asks = F.col(own).isNull() & F.col(key).isNotNull()
    any_row = F.monotonically_increasing_id()
    rows = rows.withColumns({salt: F.pmod(any_row, F.lit(SALTS)).cast("int"), key: F.when(asks, F.col(key)).otherwise(F.concat(F.lit("\0"), any_row.cast("string")))})
    side, on = few.select(F.col("_node").alias(node), F.lit(True).alias(hit)), F.col(key) == F.col(node)
    if few is taken:
        side, on = side.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), on & (F.col(salt) == F.col(part))
    rows = rows.join(side, on, "left")
    verdict = F.coalesce(F.col(own)["verdict"], F.when(F.col(hit), "block"), F.lit("allow"))
    reason = F.when(F.col(own).isNotNull(), "rule").when(F.col(hit), "alias").otherwise("none")
    return rows.select(*kept, "host", "path", F.col(own)["rule"].alias("rule"), verdict.alias("verdict"), reason.alias("reason"))


def _free(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
