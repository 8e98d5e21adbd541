"""Secret scan with corpus-wide ownership frequency.

Candidates are found by patterns in each whole text, and beside them all random-looking tokens. The hash of each value is then
counted over distinct repositories and owners of the whole corpus, wherever it stands: a value that many owners carry is an example
that was copied around, a value of few owners that also looks random is a live-looking credential. Tokens that hold such a
credential without a keyword beside it are spans as well.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.common import map_texts, packed, row_key, sha256_hex, stored, unpacked

#: Kinds and patterns of the base scan, in their order.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ["assign", "access", "hex"]
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Published formats of provider credentials; spans of these kinds are added to the base spans.
PROVIDERS = {
    "github": re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "stripe": re.compile(r"[rs]k_live_[A-Za-z0-9]{16,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
}
#: Kind of a token that is no candidate by itself; it becomes a span where another place shows that its value is a credential.
BARE = "known"
KINDS = [*BASE_KINDS, *PROVIDERS, BARE]
#: It has a digit, or a capital behind a small letter: what neither has cannot be told from words.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9]|[A-Za-z0-9+/_.=-]*?[a-z][A-Z])[A-Za-z0-9+/_.=-]{12,}")
#: A value that more than this share of all owners carry (of few owners: more than ``LEAST_OWNERS``) was copied around.
OWNER_SHARE, LEAST_OWNERS = 0.1, 1
#: Matches wherever any of the patterns above can.
SUSPECT = (
    r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|gh[opsur]_|xox[abprs]-|AIza|k_live_|eyJ|-----BEGIN |"
    r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9]|[A-Za-z0-9+/_.=-]*?[a-z][A-Z])[A-Za-z0-9+/_.=-]{12}"
)
PLACEHOLDER = re.compile(r"example|changeme|placeholder|xxxx|your[_-]|dummy|sample", re.IGNORECASE)

SPAN = "struct<kind:string,start:int,end:int,value:binary,random:boolean>"


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of every candidate, by start and then kind as listed; offsets in code points."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    for kind, pattern in PROVIDERS.items():
        found += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def bare_tokens(text: str, found: list[tuple[str, int, int, str]], least_entropy: float) -> list[tuple[str, int, int, str]]:
    """Random-looking tokens with letters and digits outside the spans found."""
    out, spans, at, end = [], sorted((s, e) for _, s, e, _ in found), 0, 0
    for m in TOKEN.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            end = max(end, spans[at][1])
            at += 1
        value = m[0]
        if end <= m.start() and any(map(str.isalpha, value)) and entropy(value) >= least_entropy:
            out.append((BARE, m.start(), m.end(), value))
    return out


def listed(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in found)


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", least_entropy: float = 2.5) -> DataFrame:
    """Every row's candidates: counts per base kind, digest of the base spans, their spans; with hashes of values, these and
    bare tokens.

    A null or empty text has no candidates. Rows are taken as they come: repeated rows are scanned each.
    """

    def fn(texts: list[bytes | None]):
        counts, digests, strings, spans = [[], [], []], [], [], []
        for raw in texts:
            text = raw.decode("utf-8", "replace") if raw else ""
            found = candidates(text)
            base = [x for x in found if x[0] in BASE_KINDS]
            n = Counter(x[0] for x in base)
            for out, kind in zip(counts, BASE_KINDS, strict=True):
                out.append(n[kind])
            digests.append(sha256_hex(listed(base)))
            strings.append(listed(found))
            bare = bare_tokens(text, found, least_entropy)
            spans.append(
                [
                    {
                        "kind": kind,
                        "start": start,
                        "end": end,
                        "value": hashlib.blake2b(value.encode(), digest_size=16).digest(),
                        "random": entropy(value) >= least_entropy and not PLACEHOLDER.search(value),
                    }
                    for kind, start, end, value in found + bare
                ]
            )
        return [*counts, digests, strings, spans]

    fields = f"n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<{SPAN}>"
    return map_texts(docs, keep, text_col, fn, fields)


def ownership(found: DataFrame, value: str, repository: str, owner: str) -> DataFrame:
    """Per value: number of distinct repositories and owners over the whole corpus.

    Rows shrink to distinct (value, owner, repository) before they are counted, so a value that a third of all rows
    carry is no hot key. A null owner or repository counts as one of its own.
    """
    pairs = found.select(value, owner, repository).distinct()
    owners = pairs.groupBy(value, owner).agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy(value).agg(
        F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")
    )


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository: Column | None = None,
    owner: Column | None = None,
    owner_share: float = OWNER_SHARE,
    least_owners: int = LEAST_OWNERS,
) -> DataFrame:
    """One row per document with its spans and the corpus-wide verdict on each.

    ``found`` lists (kind, start, end, n_repositories, n_owners, live). A span is ``live`` when its value looks random and at most
    ``owner_share`` of all owners of the corpus have it, ``least_owners`` at least. A bare token is a span, and live, where its
    value is a live candidate somewhere else; ``spans`` lists these too. A null owner is an owner. Documents without spans
    have zero counts and no list; so have null and empty texts. Very long texts are scanned whole. Rows that repeat id, text, repository and owner get equal results, one row each. Other
    columns of ``docs``, whatever their names, do not matter.
    """
    owner = F.lit(None).cast("string") if owner is None else owner.cast("string")
    repository = owner if repository is None else repository.cast("string")
    own = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"), repository.alias("repo"), owner.alias("own")
    ).withColumn("key", row_key("id", "body", "repo", "own"))
    scanned = stored(scan(own, ["id", "key", "repo", "own"], "body"), "secrets")
    n_owners = scanned.select("own").distinct().count()
    most_owners = max(least_owners, int(owner_share * n_owners))
    spans = scanned.where(F.size("found") > 0).dropDuplicates(["key"]).select("key", "repo", "own", F.explode("found").alias("f"))
    spans = spans.select("key", "repo", "own", "f.*")
    asked = spans.where(F.col("kind") != BARE).select("value").distinct()
    spans = stored(spans.join(asked, "value"), "secret-values")
    counts = ownership(spans, "value", "repo", "own")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    judged = (
        spans.join(counts, "value")
        .withColumn("live", F.col("random") & (F.col("n_owners") <= most_owners))
        .where(F.col("live") | (F.col("kind") != BARE))
        .withColumn("text", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")))
        .groupBy("key")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("start", "end", "kind", "n_repositories", "n_owners", "live"))
            ).alias("found"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", order.alias("kind"), "text"))), lambda x: x["text"]), ",").alias("all"),
            F.count_if("live").alias("n_live"),
            F.count_if(F.col("kind") == BARE).alias("n_known"),
            F.count_if(F.col("n_owners") > most_owners).alias("n_shared"),
        )
    )
    return (
        scanned.drop("found")
        .join(judged, "key", "left")
        .select(
            F.col("id").alias(id_col), "key", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("all", "spans").alias("spans"),
            F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"),
            F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"),
            F.coalesce("n_known", F.lit(0).cast("long")).alias("n_known"),
            "found",
        )
    )


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every live-looking credential in ``text_col`` replaced by ``mask``; rows and other columns stay.

    Overlapping spans are masked as one. Only rows that can hold a candidate or a bare token are scanned and joined with the
    verdicts. Null and empty texts stay as they are; repeated rows are masked alike; texts of any length are masked whole; columns
    of clashing names stay; an empty table gives none.
    """
    suspect = F.coalesce(F.col(f"`{text_col}`").rlike(SUSPECT), F.lit(False))
    hit = docs.where(suspect)
    owner, repository = options.pop("owner", None), options.pop("repository", None)
    id_col = options.get("id_col", "doc_id")
    verdicts = find_secrets(hit, text_col=text_col, owner=owner, repository=repository, **options)
    verdicts = (
        verdicts.where("n_live > 0")
        .dropDuplicates(["key"])
        .select(F.col("key").alias("verdict"), F.filter("found", lambda x: x["live"]).alias("live"))
    )
    owner = F.lit(None).cast("string") if owner is None else owner.cast("string")
    repository = owner if repository is None else repository.cast("string")
    own = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"), repository.alias("repo"), owner.alias("own"))
    keyed = packed(hit, own=own, body=F.col(f"`{text_col}`")).withColumn("key", row_key_of("own"))
    joined = keyed.join(verdicts, F.col("key") == F.col("verdict"), "left")
    starts = F.transform("live", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e")))
    body = F.col("body")
    # Left to right: text so far, and the offset up to which the original text is dealt with.
    folded = F.aggregate(
        starts,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(
                x["s"] >= acc["at"],
                F.concat(acc["out"], F.substring(body, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask)),
            ).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["e"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    masked = F.when(F.col("live").isNull(), body).otherwise(folded)
    changed = joined.select(*unpacked("row", docs.columns, **{text_col: masked}))
    return docs.where(~suspect).unionByName(changed)


def row_key_of(struct: str):
    """As ``row_key`` over the fields id, body, repo, own of a struct column."""
    c = [F.col(struct)[n] for n in ("id", "body", "repo", "own")]
    return F.struct(F.xxhash64(*c).alias("a"), F.xxhash64(F.lit(4), *c[::-1]).alias("b"))
