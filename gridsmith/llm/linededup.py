"""Line deduplication by a tree of log templates of fixed depth.

A line's tokens lead it down the tree: first by their number, then by each of its
LEAD leading tokens.  Tokens that hold a digit are variable from the start (written
<*>); what a line is then is its exact template.  A leaf holds the exact templates
of one length and lead, and generalises their variable fields: at each place a
token is fixed if at least LEAST_DOCS of the leaf's exact templates have it there,
and FIXED_SHARE of them; all others are variable.  A generalised template counts if
at least LEAST_FIXED and GENERAL_SHARE of its tokens are fixed and it has
LEAST_GENERAL tokens or more.  Unlike the one-pass form of such parsers, which
compares each line with the templates that came before, this does not depend on the
order of lines, holds no leaf in memory and counts tokens, templates and documents
with partial sums, so a line or leaf of any frequency is spread over all tasks.

A template that occurs in at least LEAST_DOCS documents recurs; of templates of
over LONG_TOKENS tokens, which do not meet by chance, LONG_DOCS documents suffice.
A line whose exact template recurs stays in the template's first document and goes
from the others.  A line whose exact template does not recur, but whose generalised
one does, stays in that one's first document and goes from the others.  So no line
that recurs word for word goes from everywhere.  Lines of fewer than LEAST_TOKENS
tokens, or of fewer than LEAST_FIXED fixed ones, are left alone, and so are repeats
within one document.

Every row is a document.  Rows are ordered by doc_id, null last, then by a digest of
the text; the least is the first.  Rows equal in both count one by one, share their
place, and so all keep what they are first with.  Null texts stay null; empty texts
stay empty; a text all of whose lines go becomes empty.  Other columns of any name
stay as they are.

The texts are read three times: for (template, leaf, row) rows, 32 bytes a line;
for the words of those leaves that have enough templates to generalise; and at last
to take the lines out, the one time that texts are shuffled, by doc_id and digest.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import map_batches, slices, table
from gridsmith.llm.scratch import Scratch, fresh

LEAST_DOCS, LONG_DOCS = 3, 2
LONG_TOKENS = 50
LEAST_TOKENS, LEAST_FIXED = 3, 3
LEAD, LEAST_GENERAL = 2, 5
FIXED_SHARE, GENERAL_SHARE = 0.05, 0.6
SMALL_LEAVES = 500_000
SENT_TEMPLATES = 100_000
BLANK = " \t\r\f\v"
_SPLIT = re.compile(r"[ \t\r\f\v]+").split
_DIGIT = re.compile("[0-9]").search
ANY = "<*>"
LAST = (1 << 63) - 1
#: No leaf: the line is too short to generalise.
NONE = 0


def masked(line: str) -> list[str]:
    """The exact template of a line as tokens; empty if it is too short."""
    line = line.strip(BLANK)
    tokens = _SPLIT(line) if line else []
    if len(tokens) < LEAST_TOKENS:
        return []
    if _DIGIT(line):
        tokens = [ANY if _DIGIT(t) else t for t in tokens]
        if len(tokens) - tokens.count(ANY) < LEAST_FIXED:
            return []
    return tokens


def _signed(h: int) -> int:
    return (h ^ (1 << 63)) - (1 << 63)


def key(tokens: list[str]) -> int:
    """63-bit hash of an exact template and, as the lowest bit, whether it is long; as a signed long."""
    return _signed(xxhash.xxh3_64_intdigest(" ".join(tokens)) & ~1 | (len(tokens) > LONG_TOKENS))


def leaf(tokens: list[str]) -> int:
    """The leaf below length and lead, or NONE."""
    n = len(tokens)
    return _signed(xxhash.xxh3_64_intdigest(f"{n} " + " ".join(tokens[:LEAD])) | 1) if n >= LEAST_GENERAL else NONE


def _pairs(docs: DataFrame) -> DataFrame:
    """(template, leaf, doc_id, digest), once a row, of rows of (doc_id, digest, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                every, leaves, ids, digests = [], [], [], []
                for k, d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    own = {key(tokens): leaf(tokens) for line in (t or "").split("\n") if (tokens := masked(line))}
                    every.extend(own)
                    leaves.extend(own.values())
                    ids.extend([k] * len(own))
                    digests.extend([d] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (every, leaves, ids, digests)], names=["template", "leaf", "doc_id", "digest"])

    return map_batches(docs, run, "template bigint, leaf bigint, doc_id bigint, digest bigint")


def _lines(rows: DataFrame, leaves: frozenset[int] | None) -> DataFrame:
    """(leaf, template, line) of the lines in ``leaves``, or of those whose template is in the row's second column, at most once a task as far as memory serves."""

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], []]
                wanted = part.column(1).to_pylist() if leaves is None else [None] * part.num_rows
                for t, own in zip(part.column(0).to_pylist(), wanted, strict=True):
                    own = own and frozenset(own)
                    for line in (t or "").split("\n"):
                        tokens = masked(line)
                        if not tokens or (where := leaf(tokens)) == NONE or own is None and where not in leaves:
                            continue
                        k = key(tokens)
                        if k in sent or own is not None and k not in own:
                            continue
                        if len(sent) >= SENT_TEMPLATES:
                            sent.clear()
                        sent.add(k)
                        for column, value in zip(out, (where, k, " ".join(tokens)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["leaf", "template", "line"])

    return map_batches(rows, run, "leaf bigint, template bigint, line string")


def _least(template, least_docs: int, long_docs: int):
    """The documents that a template must occur in."""
    return F.when(template.bitwiseAND(F.lit(1)) == 1, long_docs).otherwise(least_docs)


def generalised(lines: DataFrame, leaves: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """template and general (a hash, its lowest bit as in ``key``) of rows of (leaf, template, line); ``leaves`` has leaf and total."""
    words = F.split("line", " ")
    tokens = lines.select("leaf", "template", F.size(words).alias("n"), F.posexplode(words).alias("at", "token")).where(F.col("token") != ANY)
    counts = tokens.groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least_docs)
    fixed = counts.join(leaves, "leaf").where(F.col("c") >= F.col("total") * FIXED_SHARE).select("leaf", "at", "token")
    # what is left of a template are its fixed tokens and their places; a leaf has one length
    kept = tokens.join(fixed, ["leaf", "at", "token"]).groupBy("leaf", "template", "n").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("kept"))
    kept = kept.where((F.size("kept") >= LEAST_FIXED) & (F.size("kept") >= F.col("n") * GENERAL_SHARE - 1e-9))
    hashed = F.xxhash64("leaf", "kept").bitwiseAND(F.lit(-2)).bitwiseOR((F.col("n") > LONG_TOKENS).cast("long"))
    return kept.select("template", hashed.alias("general"))


def _not_first(held: DataFrame, by: str, scratch: Scratch) -> DataFrame:
    """(template, doc_id, digest) of the rows of ``held`` that are not the first of their ``by``; first_doc is its least doc_id."""
    held = scratch.keep(held)
    # those whose first doc_id several rows have; none if doc_ids are distinct
    firsts = held.where("doc_id = first_doc").groupBy(by).agg(F.min("digest").alias("first"), F.max("digest").alias("last"))
    firsts = scratch.keep(firsts.where("first <> last").select(by, "first"))
    gone = held.where("doc_id <> first_doc").select("template", "doc_id", "digest")
    if firsts.take(1):
        gone = gone.unionByName(held.where("doc_id = first_doc").join(firsts, by).where("digest <> first").select("template", "doc_id", "digest"))
    return gone


def dropped(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """(template, doc_id, digest): the exact templates whose lines go, for ``docs`` of (doc_id, digest, text) with no null doc_id."""
    pairs = scratch.keep(_pairs(docs))
    known = scratch.keep(pairs.groupBy("template").agg(F.max("leaf").alias("leaf"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")))
    recurs = F.col("n_docs") >= _least(F.col("template"), least_docs, long_docs)
    exact = known.where(recurs).select("template", "first_doc")
    gone = _not_first(pairs.join(exact, "template").select("template", "doc_id", "digest", "first_doc"), "template", scratch)
    # leaves that may generalise: enough exact templates, one of them not recurring as it is
    leaves = known.where(F.col("leaf") != NONE).groupBy("leaf").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~recurs, 1)).alias("open"))
    leaves = scratch.keep(leaves.where((F.col("total") >= least_docs) & (F.col("open") > 0)).select("leaf", "total"))
    if not (many := leaves.count()):
        return gone
    if many <= SMALL_LEAVES:
        lines = _lines(docs.select("text"), frozenset(r["leaf"] for r in leaves.select("leaf").collect()))
    else:
        held = known.join(leaves, "leaf").select("template", F.col("first_doc").alias("doc_id"))
        wanted = pairs.join(held, ["template", "doc_id"]).groupBy("doc_id", "digest").agg(F.collect_set("template").alias("wanted"))
        lines = _lines(docs.join(scratch.keep(wanted), ["doc_id", "digest"]).select("text", "wanted"), None)
    lines = scratch.keep(lines.dropDuplicates(["template"]))
    # recurring templates take part in the leaf, but their lines are decided already
    groups = scratch.keep(generalised(lines, leaves, least_docs))
    held = scratch.keep(pairs.join(groups, "template").select("general", "template", "doc_id", "digest"))
    once = held.groupBy("general", "template", "doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    once = once.groupBy("general", "doc_id", "digest").agg(F.max("rows").alias("rows"))
    often = once.groupBy("general").agg(F.sum("rows").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    often = scratch.keep(often.where(F.col("n_docs") >= _least(F.col("general"), least_docs, long_docs)).select("general", "first_doc"))
    loose = _not_first(held.join(often, "general"), "general", scratch)
    return gone.unionByName(loose.join(exact, "template", "left_anti"))


def drop_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, counts: bool = False, long_docs: int = LONG_DOCS) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the recurring lines taken out of ``text``.

    ``counts`` adds n_lines and n_dropped; ``long_docs`` documents suffice for long templates in place of ``least_docs``.
    """
    if counts and (taken := {"n_lines", "n_dropped"} & {c.lower() for c in docs.columns}):
        raise ValueError(f"columns that counts would add exist already: {', '.join(sorted(taken))}")
    scratch = Scratch(docs.sparkSession)
    key_, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.col("text").cast("string")
    digest = F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")
    gone = dropped(docs.select(key_.alias("doc_id"), digest.alias("digest"), text.alias("text")), scratch, least_docs, long_docs)
    of_id, of_text, templates = fresh(docs.columns, "gone_id", "gone_digest", "gone")
    gone = gone.groupBy(F.col("doc_id").alias(of_id), F.col("digest").alias(of_text)).agg(F.collect_set("template").alias(templates))
    rows = docs.join(scratch.last(gone), (key_ == F.col(of_id)) & (digest == F.col(of_text)), "left").drop(of_id, of_text)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts, lines, lost = [], [], []
                for t, gone_ in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                    parts = t.split("\n") if t else []
                    kept = parts
                    if gone_ and parts:
                        gone_ = frozenset(gone_)
                        kept = [x for x in parts if not (tokens := masked(x)) or key(tokens) not in gone_]
                    texts.append(t if len(kept) == len(parts) else "\n".join(kept))
                    lines.append(len(parts))
                    lost.append(len(parts) - len(kept))
                columns = [*part.columns[:at], pa.array(texts, pa.string()), *part.columns[at + 1 : len(names)]]
                extra = [pa.array(lines, pa.int64()), pa.array(lost, pa.int64())] if counts else []
                yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, *["n_lines", "n_dropped"][: len(extra)]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(rows, run, schema + (", n_lines bigint, n_dropped bigint" if counts else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document without the lines that recur, and how many there were and went."""
    return drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


ORACLE_SQL = rf"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, text,
         {{'k': coalesce(doc_id, {LAST}), 'd': ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT}} AS id
  FROM documents),
line AS MATERIALIZED (
  SELECT rid, id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM doc WHERE text <> ''),
tok AS (
  SELECT rid, id, pos,
         [CASE WHEN regexp_matches(t, '[0-9]') THEN '{ANY}' ELSE t END
          FOR t IN regexp_split_to_array(trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)), '[ 	
]+') IF t <> ''] AS t
  FROM line),
held AS MATERIALIZED (
  SELECT rid, id, pos, t, len(t) AS n FROM tok
  WHERE len(t) >= {LEAST_TOKENS} AND len(list_filter(t, lambda x: x <> '{ANY}')) >= {LEAST_FIXED}),
exact AS MATERIALIZED (
  SELECT t, n, n_docs, first_id, n_docs >= CASE WHEN n > {LONG_TOKENS} THEN {LONG_DOCS} ELSE {LEAST_DOCS} END AS recurs
  FROM (SELECT t, any_value(n) AS n, count(DISTINCT rid) AS n_docs, min(id) AS first_id FROM held GROUP BY t)),
leaf AS (
  SELECT n, t[1:{LEAD}] AS lead, count(*) AS total FROM exact WHERE n >= {LEAST_GENERAL} GROUP BY ALL
  HAVING count(*) >= {LEAST_DOCS} AND NOT bool_and(recurs)),
token AS MATERIALIZED (
  SELECT t, n, lead, total, unnest(t) AS token, generate_subscripts(t, 1) AS place
  FROM (SELECT e.t, e.n, leaf.lead, total FROM exact e JOIN leaf ON e.n = leaf.n AND e.t[1:{LEAD}] = leaf.lead)),
fixed AS (
  SELECT n, lead, place, token FROM token WHERE token <> '{ANY}' GROUP BY ALL
  HAVING count(*) >= {LEAST_DOCS} AND count(*) >= any_value(total) * {FIXED_SHARE}),
general AS MATERIALIZED (
  SELECT t, any_value(n) AS n, any_value(lead) AS lead, list({{'place': place, 'token': token}} ORDER BY place) AS g
  FROM token JOIN fixed USING (n, lead, place, token) GROUP BY t
  HAVING count(*) >= {LEAST_FIXED} AND count(*) >= any_value(n) * {GENERAL_SHARE} - 1e-9),
often AS (
  SELECT n, lead, g, min(id) AS first_id FROM held JOIN general USING (t, n) GROUP BY ALL
  HAVING count(DISTINCT rid) >= CASE WHEN n > {LONG_TOKENS} THEN {LONG_DOCS} ELSE {LEAST_DOCS} END),
decided AS (
  SELECT e.t, CASE WHEN e.recurs THEN e.first_id ELSE o.first_id END AS first_id
  FROM exact e LEFT JOIN general q ON e.t = q.t LEFT JOIN often o ON q.n = o.n AND q.lead = o.lead AND q.g = o.g),
gone AS (SELECT rid, pos FROM held JOIN decided USING (t) WHERE first_id IS NOT NULL AND id <> first_id),
done AS (
  SELECT line.rid, string_agg(line, chr(10) ORDER BY line.pos) FILTER (WHERE gone.pos IS NULL) AS text,
         count(*) AS n_lines, count(gone.pos) AS n_dropped
  FROM line LEFT JOIN gone ON line.rid = gone.rid AND line.pos = gone.pos GROUP BY line.rid)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN d.text = '' THEN '' ELSE coalesce(done.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM doc d LEFT JOIN done ON d.rid = done.rid
"""
