"""URL rules found through their rarest literal token.

A rule is a regular expression over host and path with the literal tokens that
any URL it fits must hold. It is indexed under the one that is rarest among
the URLs at hand. The tokens of a URL fetch its candidate rules, and only their
expressions run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.session import shared_table

#: Rules up to this number are broadcast; more meet the URLs in a shuffled join.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words that a host of unwanted pages bears as a part of its name.
UNWANTED = ("ads adserver adult adultery affiliate affiliates bet bets betting bingo blackjack camgirl camgirls cams casino "
            "casinos cheap-pills cialis clickbait clickfarm counterfeit cracks crackz doorway doubleclick erotic erotica escort "
            "escorts fetish free-bets gambling hentai hookup hookups jackpot jackpots keygen keygens levitra linkfarm linkpark "
            "lottery loans malware milf nude nudes nulled parked payday payday-loans phishing pills poker pokies popads popunder "
            "porn porno porntube replica replicas roulette sexcam sexcams sexshop slots sportsbook spam spamfarm spyware swingers "
            "torrent torrents track tracker trackers tracking tramadol valium viagra warez weightloss xanax xxx").split()
# Folders of a path that hold no articles.
FOLDERS = ("account ads adserver affiliates auth basket cart cgi-bin checkout comment-page cookie-policy cookies feed feeds "
           "forgot-password impressum legal-notice login logout members oauth order-status password-reset pixel popup preview "
           "print privacy-policy profile-edit register rss search-results session share shopping-cart signin signup sitemap "
           "sponsored subscribe tagged terms-of-service track tracking trackback unsubscribe wishlist wp-admin wp-json "
           "wp-login xmlrpc").split()
# Endings of files that are no pages.
ENDINGS = ("7z apk avi bin bmp bz2 css csv deb dll dmg doc docx eot epub exe flac flv gif gz ico iso jar jpeg jpg js json m3u8 "
           "m4a map mid mkv mobi mov mp3 mp4 mpeg mpg msi odp ods odt ogg otf pdf pkg png ppt pptx ps rar rpm rtf svg swf tar "
           "tgz tiff ts ttf txt wav webm webp wma wmv woff woff2 xls xlsx xml xz zip").split()

RULE_SCHEMA = "rule string, pattern string, tokens array<string>, verdict string, weight int"


def host_rule(rule: str, verdict: str) -> tuple:
    """A rule such as ``example.org/en/1``: this host and all below it, this start of the path."""
    host, slash, path = rule.partition("/")
    path = slash + path
    whole = path[:path.rfind("/") + 1]  # a last part may be a start only
    return rule, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", _literal(f"{host}/{whole}"), verdict, len(rule)


def _literal(*parts: str) -> list[str]:
    """The tokens that a URL with these parts must hold."""
    return [t for p in parts for t in re.split("[^a-z0-9]+", p.lower()) if t]


def name_rule(word: str) -> tuple:
    """Blocks hosts that bear ``word`` between dots and hyphens; any host rule outweighs it."""
    return None, rf"^(?:[^/]*[.-])?{re.escape(word)}(?:[.-][^/]*)?(?:/|$)", _literal(word), "block", 0


def folder_rule(name: str) -> tuple:
    """Blocks paths with the folder ``name``; any host rule outweighs it."""
    return None, rf"^[^/]*/(?:.*/)?{re.escape(name)}(?:/|$)", _literal(name), "block", 0


def ending_rule(name: str) -> tuple:
    """Blocks files that end in ``.name``; any host rule outweighs it."""
    return None, rf"^[^/]*/.*\.{re.escape(name)}$", _literal(name), "block", 0


def registered_rules() -> list[tuple]:
    """The rules of the registered query."""
    return [*(host_rule(r, v) for r, v in HOST_RULES), *map(name_rule, UNWANTED), *map(folder_rule, FOLDERS), *map(ending_rule, ENDINGS)]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.split(F.lower(place), "[^a-z0-9]+"))


def judge_urls(pages: DataFrame, rules: Iterable[tuple], otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    ``rules`` are tuples of ``RULE_SCHEMA``. Of the rules that fit, the one of
    the greatest weight decides (ties: the smallest pattern); without any the
    verdict is ``otherwise``. Repeated rules are one; a rule without a literal
    token is tried on every URL, and long URLs are matched whole. A null url, or one without ``://``, has an empty
    host and path and fits no rule. Repeated rows are judged each for itself, a
    null page_id is kept, other columns are ignored.
    """
    spark, rules = pages.sparkSession, list(rules)
    urls = shared_table(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(F.col("url")).alias("host"),
                                     path_of(F.col("url")).alias("path")))  # written, so that a row keeps its number
    place = F.concat("host", "path")
    # rules without a literal token (a host of other letters) are tried on every URL
    bare, literal = [r for r in rules if not r[2]], [r for r in rules if r[2]]
    known = spark.createDataFrame(literal, RULE_SCHEMA)
    wanted = known.select(F.explode("tokens").alias("token")).distinct()
    few = len(rules) <= BROADCAST_RULES
    wanted = F.broadcast(wanted) if few else wanted
    tokens = urls.select("*", F.explode(F.array_remove(_tokens(place), "")).alias("token"))
    found = tokens.select("token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    common = wanted.join(found, "token", "left").select("token", F.coalesce("urls", F.lit(0)).alias("urls"))
    index = (known.withColumn("token", F.explode("tokens")).join(common, "token")
             .groupBy("rule", "pattern", "verdict", "weight").agg(F.min(F.struct("urls", "token")).alias("rarest"))
             .select("rule", "pattern", "verdict", "weight", F.col("rarest.token").alias("token")))
    index = F.broadcast(index) if few else index
    fits = F.expr("concat(host, path) rlike pattern")
    best = F.max_by(F.struct("rule", "verdict", "weight", "pattern"), F.struct("weight", "pattern")).alias("best")
    hits = tokens.join(index, "token").filter(fits).groupBy("row").agg(best)
    out = urls.join(hits, "row", "left")
    for rule, pattern, _, verdict, weight in bare:
        own = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(weight).alias("weight"), F.lit(pattern).alias("pattern"))
        better = F.col("best").isNull() | (F.struct("best.weight", "best.pattern") < F.struct(F.lit(weight), F.lit(pattern)))
        out = out.withColumn("best", F.when(place.rlike(pattern) & better, own).otherwise(F.col("best")))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


# The host rules of the registered query.
HOST_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
              ("com/de/", "block")]


def sql(rules: list[tuple[str, str]] = HOST_RULES) -> str:
    """The same result over the table ``pages``, every rule tried on every URL."""
    listed = ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in rules)
    return f"""
    with u as (
      select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
      from pages),
    r(rule, verdict, rhost, rpath) as (values {listed}),
    b as (
      select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
      from u left join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
      group by page_id, host, path)
    select page_id, host, path, rule, coalesce(verdict,
           case when regexp_matches(host, '(^|[.-])({"|".join(UNWANTED)})([.-]|$)') or regexp_matches(path, '/({"|".join(FOLDERS)})(/|$)')
             or regexp_matches(path, '/.*[.]({"|".join(ENDINGS)})$') then 'block' else 'allow' end) as verdict
    from b"""
