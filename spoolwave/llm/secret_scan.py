"""Secret scan with multipart credential linking, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoolwave.llm.common import checkpoint, plain, split_small, text_col

#: Kind, pattern, least length of the match, least value (length of group 1, or 1 for a mixed token; 0: none asked for), and
#: strings of which the text in lower case must hold one for a match to be possible (none: every text is searched). The first
#: three are base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 0, 6, ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 20, 0, ("akia",)),
    ("hex", r"[0-9a-f]{24,}", 24, 0, ()),
    (
        "pair_id",
        r"""(?i:user(?:_?name|_?id)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""",
        0,
        4,
        ("user", "login", "client", "account", "access"),
    ),
    (
        "pair_secret",
        r"""(?i:pwd|pass|auth|credentials?|private_?key|client_?key|signing_?key|secret_?(?:access_?)?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        0,
        8,
        ("pwd", "pass", "auth", "credential", "private", "client", "signing", "secret"),
    ),
    ("pair_endpoint", r"(?i:https?|ftp|sftp|ssh|amqps?|redis|mysql|postgres(?:ql)?|mongodb)://[A-Za-z0-9@:._-]+", 12, 0, ("://",)),
    ("pair_token", r"[A-Za-z0-9+/]{32,}", 32, 1, ()),
)
N_BASE = 3
ACCESS, HEX, ID, SECRET, ENDPOINT, TOKEN = 1, 2, 3, 4, 5, 6
#: Two parts belong to one scope if their starts are at most this many code points apart.
SCOPE = 512


def _found(text: Column, kind: int) -> Column:
    """Array of (kind, gap before, length, value) of the leftmost non-overlapping matches, failing ones included.

    Gaps are what split leaves between the matches, so starts follow by running sums; only texts with a match are split.
    """
    _, pattern, _, value, needs = KINDS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind == TOKEN:
        worth = lambda m: (m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")).cast("int")
    else:
        worth = (lambda m: F.length(F.regexp_extract(m, pattern, 1))) if value else (lambda m: F.lit(0))
    pieces = F.split(text, pattern, -1)
    rows = F.zip_with(pieces, hits, lambda p, m: F.struct(F.lit(kind).alias("kind"), F.length(p).alias("gap"), F.length(m).alias("len"), worth(m).alias("val")))
    able = F.size(hits) > 0
    for k, need in enumerate(needs):
        one = F.contains(F.lower(text), F.lit(need))
        may = one if k == 0 else may | one
    able = may & able if needs else able
    return F.when(able, F.filter(rows, lambda r: r["len"].isNotNull())).otherwise(F.expr("cast(array() as array<struct<kind:int,gap:int,len:int,val:int>>)"))


def spans(docs: DataFrame, keys: list[str], text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(*keys, kind int, start bigint, end bigint): base spans and linked weak spans; a row with kind null for a key without.

    Rows with equal keys must hold equal texts and give their spans once. Weak parts (identifiers, secrets, endpoints) are
    reported only when complementary parts start within `scope` code points: an identifier needs a secret, a secret or a bare
    token of mixed characters needs an identifier, an endpoint needs both. Base spans count as parts: access as identifier,
    assign and hex as secret. An identifier or token inside a labelled secret is part of that secret ("secret_access_key = ..."),
    and a weak match that a base span overlaps is not reported again. The interval join is a range frame over starts, bounded by
    the scope; all other frames run from one end, so the cost is linear in the matches of a text. Offsets are code points, end
    exclusive. Null text is empty.
    """
    found = F.flatten(F.array(*[_found(F.col("_t"), k) for k in range(len(KINDS))]))
    rows = docs.select(*keys, text_col(text).alias("_t")).select(*keys, F.posexplode_outer(found).alias("pos", "m"))
    rows = rows.select(*keys, "pos", F.col("m.kind").alias("kind"), F.col("m.gap").cast("bigint").alias("gap"), F.col("m.len").alias("len"), F.col("m.val").alias("val")).repartition(*keys).dropDuplicates([*keys, "kind", "pos"])
    by_kind = Window.partitionBy(*keys, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(by_kind)).withColumn("start", F.col("end") - F.col("len"))
    least = F.create_map(*[x for k, (_, _, m, g, _) in enumerate(KINDS) for x in (F.lit(k), F.struct(F.lit(m).alias("m"), F.lit(g).alias("g")))])[F.col("kind")]
    good = F.col("kind").isNull() | ((F.col("len") >= least["m"]) & (F.col("val") >= least["g"]))
    near = Window.partitionBy(*keys).orderBy("start").rangeBetween(-scope, scope)
    has = lambda *kinds: F.max(F.col("kind").isin(*kinds)).over(near)
    up_to = Window.partitionBy(*keys).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    from_here = Window.partitionBy(*keys).orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    reach = lambda which: F.max(F.when(which, F.col("end"))).over(up_to)
    base = F.col("kind") < N_BASE
    rows = rows.withColumn("kind", F.when(good, F.col("kind")))
    rows = rows.withColumn("_over", F.coalesce(reach(base) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(base, F.col("start"))).over(from_here) < F.col("end"), F.lit(False)))
    rows = rows.withColumn("_within", reach(F.col("kind") == SECRET) > F.col("start"))
    rows = rows.withColumn("kind", F.when(F.coalesce(F.col("kind").isin(ID, TOKEN) & F.col("_within"), F.lit(False)), F.lit(None)).otherwise(F.col("kind")))
    rows = rows.withColumn("_id", has(ACCESS, ID)).withColumn("_secret", has(0, HEX, SECRET, TOKEN))
    needs_id, needs_secret = F.col("kind").isin(SECRET, ENDPOINT, TOKEN), F.col("kind").isin(ID, ENDPOINT)
    linked = (~needs_id | F.col("_id")) & (~needs_secret | F.col("_secret"))
    return rows.withColumn("kind", F.when(linked & ((F.col("kind") < N_BASE) | ~F.col("_over")), F.col("kind"))).select(*keys, "kind", F.when(F.col("kind").isNotNull(), F.col("start")).alias("start"), F.when(F.col("kind").isNotNull(), F.col("end")).alias("end"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked), one row per input row, repeated rows included.

    Null text is empty and has no spans; a null doc_id is kept. An empty table gives an empty result.
    """
    own = split_small(plain(docs, "doc_id", "text").select("doc_id", text_col().alias("text"))).withColumn("_row", F.monotonically_increasing_id())
    found = spans(own, ["_row", "doc_id"])
    names = F.create_map(*[x for k, spec in enumerate(KINDS) for x in (F.lit(k), F.lit(spec[0]))])
    ordered = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", F.concat_ws(":", names[F.col("kind")], "start", "end").alias("said")))))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k][0]}")
    out = found.groupBy("_row", "doc_id").agg(count(0), count(1), count(2), F.count(F.when(F.col("kind") >= N_BASE, 1)).alias("n_linked"), ordered.alias("_all"))
    said = lambda a: F.array_join(F.transform(a, lambda s: s["said"]), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(said(F.filter("_all", lambda s: s["kind"] < N_BASE)), 256).alias("base_sha256"), said(F.col("_all")).alias("spans"), "n_linked")


def links(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, kind, start, end, with_kind, with_start, with_end, apart): every reported part with each complementary part of its
    scope: identifiers with secrets, endpoints with identifiers and with secrets; a row for each two parts.

    The interval join is an equal join on text and stretch of `scope` code points, a part standing in its own stretch and the other
    one in that and the two beside it, with the distance verified; so parts meet what lies near them, however long a text is.
    Equal rows give their links once each; a null text has none.
    """
    own = split_small(plain(docs, "doc_id", "text").select("doc_id", text_col().alias("text"))).withColumn("_row", F.monotonically_increasing_id())
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    found = checkpoint(spans(own, ["_row", "doc_id"], scope=scope).where("kind is not null"))
    role = F.when(F.col("kind").isin(ACCESS, ID), "identifier").when(F.col("kind") == ENDPOINT, "endpoint").otherwise("secret")
    part = found.select("_row", "doc_id", role.alias("role"), F.element_at(names, F.col("kind") + 1).alias("kind"), "start", "end", F.floor(F.col("start") / scope).alias("_at"))
    others = part.where("role <> 'endpoint'").select(F.col("_row").alias("_of"), F.col("role").alias("with_role"), F.col("kind").alias("with_kind"), F.col("start").alias("with_start"), F.col("end").alias("with_end"), F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1)).alias("_near"))
    apart = F.abs(F.col("start") - F.col("with_start"))
    fits = ((F.col("role") == "identifier") & (F.col("with_role") == "secret")) | (F.col("role") == "endpoint")
    met = part.join(others, (F.col("_row") == F.col("_of")) & (F.col("_at") == F.col("_near")) & (apart <= scope) & fits)
    return met.select("doc_id", "kind", "start", "end", "with_kind", "with_start", "with_end", apart.alias("apart"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by a mark (overlapping spans by one), n_chars following; other rows unchanged.

    Spans are found once for rows that are equal in id and text, null ids included; a null text stays null. An empty table stays
    empty.
    """
    given, docs = docs.columns, plain(docs, "doc_id", "text", "n_chars")
    digest = F.md5(text_col("text"))
    keyed = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), digest.alias("_digest"))
    found = spans(keyed, ["doc_id", "_digest"]).where("kind is not null")
    # merge overlaps: a span opens a run if no earlier one reaches it
    order = Window.partitionBy("doc_id", "_digest").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("_opens", F.when(reach.isNull() | (reach < F.col("start")), 1).otherwise(0)).withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "_digest", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    by_start = Window.partitionBy("doc_id", "_digest").orderBy("start")
    kept = merged.withColumn("_from", F.coalesce(F.lag("end").over(by_start), F.lit(0)))
    cuts = kept.groupBy(F.col("doc_id").alias("_cut_id"), F.col("_digest").alias("_cut_digest")).agg(F.array_sort(F.collect_list(F.struct("_from", "start"))).alias("_cuts"), F.max("end").alias("_tail"))
    names = docs.columns
    joined = docs.withColumn("_digest", digest).join(cuts, F.col("doc_id").eqNullSafe(F.col("_cut_id")) & (F.col("_digest") == F.col("_cut_digest")), "left")
    pieces = F.transform("_cuts", lambda c: F.concat(F.substring("text", c["_from"].cast("int") + 1, (c["start"] - c["_from"]).cast("int")), F.lit(mark)))
    clean = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), F.col("_tail").cast("int") + 1, F.length("text"))))
    joined = joined.withColumn("text", clean)
    if "n_chars" in names:
        joined = joined.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return joined.select(*names).toDF(*given)


def _oracle() -> str:
    """DuckDB form: positions by running sums of split pieces, linking as an EXISTS interval join."""
    parts = []
    for k, (_, pattern, m, g, _) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        v = f"length(regexp_extract(hit, '{p}', 1))" if g else "0"
        if k == TOKEN:
            v = "(regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Z]') and regexp_matches(hit, '[a-z]'))::int"
        parts.append(
            f"select r, doc_id, {k} as kind, n, length(piece) as gap, length(hit) as len, {v} as val, {m} as m, {g} as g from (select r, doc_id, unnest(string_split_regex(t, '{p}')) as piece, "
            f"unnest(regexp_extract_all(t, '{p}')) as hit, unnest(range(1, 1 + len(regexp_extract_all(t, '{p}')))) as n from d where regexp_matches(t, '{p}')) where hit is not null"
        )
    named = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
raw as ({' union all '.join(parts)}),
placed as (select *, sum(gap + len) over (partition by r, kind order by n) as e from raw),
good as (select r, doc_id, kind, (e - len)::bigint as s, e::bigint as e from placed where len >= m and val >= g),
ok as (select * from good a where kind not in ({ID}, {TOKEN}) or not exists (select 1 from good b where b.r = a.r and b.kind = {SECRET} and b.s <= a.s and b.e > a.s)),
linked as (select * from ok a where kind < {N_BASE} or (
  (kind in ({SECRET}, {TOKEN}) or exists (select 1 from ok b where b.r = a.r and b.kind in (0, {HEX}, {SECRET}, {TOKEN}) and abs(b.s - a.s) <= {SCOPE}))
  and (kind = {ID} or exists (select 1 from ok b where b.r = a.r and b.kind in ({ACCESS}, {ID}) and abs(b.s - a.s) <= {SCOPE}))
  and not exists (select 1 from ok b where b.r = a.r and b.kind < {N_BASE} and b.s < a.e and b.e > a.s))),
said as (select r, kind, s, {named}[kind + 1] || ':' || s || ':' || e as x from linked)
select d.doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  count(*) filter (kind >= {N_BASE}) as n_linked,
  sha256(coalesce(string_agg(x, ',' order by s, kind) filter (kind < {N_BASE}), '')) as base_sha256,
  coalesce(string_agg(x, ',' order by s, kind), '') as spans
from d left join said on said.r = d.r group by d.r, d.doc_id
"""


ORACLE_SQL = _oracle()
