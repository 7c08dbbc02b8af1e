"""Queries of the core, by name, each with its SQL.

The civic tables are read as they are. Where a query needs entities and is to be checked by SQL, records
with one normalized name are one entity; ``entities`` and what follows from it use pair scoring instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions import text as T
from daftar.operators import components, graph, ingest, links, resolve, scores
from daftar.plans import sqltext as S
from daftar.runtime import cut, table
from daftar.sources import rejects

AMOUNTS = {"fbr_tax_records_complex": "declared_income_pkr", "disco_consumption_complex": "avg_monthly_bill_pkr", "property_transfers_complex": "property_value_pkr"}
CIVIC = ["fbr_tax_records_complex", "excise_vehicles_complex", "disco_consumption_complex", "property_transfers_complex"]
NAME = dict(zip(CIVIC, ["full_name", "owner_name", "consumer_name", "buyer_name"]))
ADDRESS = dict(zip(CIVIC, ["reported_address", "owner_address", "installation_address", "property_address"]))
QUERIES, SQL = {}, {}


def query(sql=None):
    """Register a query by its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- lines and cells that fail to parse -------------------------------------------------------------

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_AMOUNT = r"(?i)(?:(?:pkr|rs\.?)\s*)?[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:/-)?"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def _lines_sql() -> str:
    cases, cells = [], []
    for name, (fields, number) in rejects.LAYOUTS.items():
        n, at = len(fields), fields.index(number)
        whole = _FIELD + "".join([f",{_FIELD}"] * (n - 1))
        cases.append(f"WHEN file_name = '{name}' THEN regexp_full_match(l, '{whole}', 's')")
        cells.append(f"WHEN file_name = '{name}' THEN regexp_extract(l, '^(?:{_FIELD},){{{at}}}({_FIELD})', 1, 's')")
    return f"""
lines AS (SELECT record_id, file_name, coalesce(regexp_replace(line, '\\r$', ''), '') AS l FROM raw_records),
shaped AS (SELECT *, CASE {' '.join(cases)} END AS whole, regexp_full_match(l, '{_FIELD}(?:,{_FIELD})*', 's') AS quoted, CASE {' '.join(cells)} END AS raw FROM lines),
cells AS (SELECT *, trim(CASE WHEN raw LIKE '"%' THEN replace(raw[2:-2], '""', '"') ELSE raw END, {_BLANKS}) AS cell FROM shaped),
reasons AS (SELECT *, CASE WHEN l = '' THEN 'columns' WHEN whole THEN CASE WHEN cell <> '' AND NOT regexp_full_match(cell, '{_AMOUNT}') THEN 'value' END WHEN NOT quoted THEN 'quoting' ELSE 'columns' END AS reason FROM cells)"""


def _p3_sql() -> str:
    rows = "".join(f"\nUNION ALL SELECT record_id, 'value' FROM {t} WHERE trim({c}, {_BLANKS}) <> '' AND NOT regexp_full_match(trim({c}, {_BLANKS}), '{_AMOUNT}')" for t, c in AMOUNTS.items())
    return f"WITH {_lines_sql()}\nSELECT record_id, reason FROM reasons WHERE reason IS NOT NULL{rows}"


@query(_p3_sql())
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Failing lines and rows, with the reason."""
    out = rejects.checked_lines(table(spark, d, "raw_records")).filter("reason is not null").select("record_id", "reason")
    for name, column in AMOUNTS.items():
        out = out.unionAll(rejects.rejected_cells(table(spark, d, name).select("record_id", column), column))
    return out


@query()
def p3_broken_field(spark, d):
    """Number of the first broken field of each line that is no row."""
    return rejects.checked_lines(table(spark, d, "raw_records")).filter("broken_field is not null").select("record_id", "reason", "broken_field")


def _rows_sql(name: str) -> str:
    fields, number = rejects.LAYOUTS[name]
    plain = lambda r: f"CASE WHEN {r} LIKE '\"%' THEN replace(({r})[2:-2], '\"\"', '\"') ELSE {r} END"
    cell = lambda i: plain(f"regexp_extract(l, '^(?:{_FIELD},){{{i}}}({_FIELD})', 1, 's')")
    value = f"try_cast(regexp_replace(regexp_replace(cell, '(?i)rs\\.|/-', '', 'g'), '[^0-9.]', '', 'g') AS double)"
    return f"WITH {_lines_sql()}\nSELECT record_id, {', '.join(f'{value} AS {f}' if f == number else f'{cell(i)} AS {f}' for i, f in enumerate(fields))} FROM reasons WHERE reason IS NULL AND file_name = '{name}'"


@query(_rows_sql("fbr_tax_records_complex.csv"))
def p3_tax_rows(spark, d):
    """The good tax lines as typed rows."""
    return rejects.good_rows(table(spark, d, "raw_records"), "fbr_tax_records_complex.csv")


@query(_rows_sql("disco_consumption_complex.csv"))
def p3_utility_rows(spark, d):
    return rejects.good_rows(table(spark, d, "raw_records"), "disco_consumption_complex.csv")


@query(_rows_sql("property_transfers_complex.csv"))
def p3_property_rows(spark, d):
    return rejects.good_rows(table(spark, d, "raw_records"), "property_transfers_complex.csv")


# --- ingestion ------------------------------------------------------------------------------------


def _profile_sql(name: str, columns: list[str], order: str) -> str:
    kind, mapping = ingest.settle(columns, name)
    fields: dict = {}
    for f, c in mapping.items():
        fields.setdefault(c, f)
    parts = []
    for c in columns:
        blank = f"({c} IS NULL OR trim(cast({c} AS varchar)) = '')"
        samples = f"(SELECT string_agg(v, ' | ' ORDER BY r, v) FROM (SELECT cast({c} AS varchar) AS v, min({order}) AS r FROM {name} WHERE NOT {blank} GROUP BY 1 ORDER BY r, v LIMIT 3))"
        field = S.q(fields[c]) if c in fields else "cast(NULL AS varchar)"
        parts.append(f"SELECT '{name}' AS dataset, '{kind}' AS kind, '{c}' AS \"column\", {field} AS field, count(*) AS rows, count_if({blank}) AS missing, round(count_if({blank}) / greatest(count(*), 1), 3) AS missing_ratio, coalesce({samples}, '') AS samples FROM {name}")
    return " UNION ALL ".join(parts)


_TAX = "fbr_id full_name declared_income_pkr tax_paid_pkr filer_status reported_address phone_number ntn source_note source_channel".split()
_DEEDS = "registry_no buyer_name seller_name property_address property_value_pkr transfer_date property_type buyer_phone source_note".split()


@query(_profile_sql("fbr_tax_records_complex", _TAX, "source_row_id"))
def profile_tax(spark, d):
    """Rows, missing ratio, field and first samples of each text column of the tax table."""
    df = table(spark, d, "fbr_tax_records_complex").select(F.col("source_row_id").alias("_row"), *_TAX)
    return ingest.profile(df, "fbr_tax_records_complex", "_row")


@query(_profile_sql("property_transfers_complex", _DEEDS, "source_row_id"))
def profile_property(spark, d):
    df = table(spark, d, "property_transfers_complex").select(F.col("source_row_id").alias("_row"), *_DEEDS)
    return ingest.profile(df, "property_transfers_complex", "_row")


_COLUMNS = {
    "fbr_tax_records_complex": _TAX, "property_transfers_complex": _DEEDS + ["area_marla"],
    "excise_vehicles_complex": "vehicle_reg_no owner_name engine_capacity_cc vehicle_make_model registration_year owner_address owner_phone chassis_no source_note".split(),
    "disco_consumption_complex": "meter_ref_no consumer_name installation_address avg_monthly_bill_pkr connection_type phone_number division source_note".split(),
}


def _canonical(spark, d):
    return ingest.canonical_records({t: table(spark, d, t).select("source_row_id", *_COLUMNS[t]) for t in CIVIC})


def _canonical_sql() -> str:
    every = list(dict.fromkeys(f for fields in ingest.KIND_FIELDS.values() for f in fields))
    parts = []
    for t in CIVIC:
        kind, mapping = ingest.settle(["source_row_id", *_COLUMNS[t]], t)
        cols = []
        for f in every:
            value = f"cast({mapping[f]} AS varchar)" if f in mapping else "''"
            if f not in ingest.KIND_FIELDS[kind]:
                cols.append(f"cast(NULL AS {'double' if f in ingest.NUMBERS else 'varchar'}) AS {f}")
            elif f in ingest.NUMBERS:
                cols.append(f"{S.clean_number(mapping[f])} AS {f}")
            else:
                cols.append((f"coalesce(trim({value}), 'None')" if f == "filer_status" else value) + f" AS {f}")
        parts.append(
            f"SELECT '{t}' AS source_dataset, cast(source_row_id AS varchar) AS source_row_id, '{t}:' || source_row_id AS record_id, '{kind}' AS source_kind, '{kind}' AS record_type, {mapping['person_name']} AS person_name, {mapping['address']} AS address, {', '.join(cols)} FROM {t}"
        )
    return " UNION ALL ".join(parts)


@query(_canonical_sql())
def canonical_records(spark, d):
    """All rows of the four tables in one canonical form."""
    return _canonical(spark, d)


# --- normalization -----------------------------------------------------------------------------------

_RECORDS = f"records AS ({_canonical_sql()})"


@query(f"""WITH {_RECORDS}, n AS (SELECT record_id, {S.normalize_text('person_name')} AS norm_text FROM records), t AS (SELECT *, {S.name_tokens('norm_text')} AS tokens FROM n)
SELECT record_id, norm_text, {S.joined('tokens')} AS norm_name, coalesce(list_aggregate(list_transform(tokens, lambda w: w[1:1]), 'string_agg', ''), '') AS initials, coalesce(tokens[-1], '') AS surname,
coalesce(tokens[1][1:1], '') AS first_initial, {S.joined('list_sort(' + S.alias_tokens('tokens') + ')')} AS aliases, {S.joined('list_sort(list_filter(list_distinct(list_transform(tokens, lambda w: ' + S.phonetic_code('w') + ")), lambda c: c <> ''))")} AS codes FROM t""")
def normalized_names(spark, d):
    """Names normalized, with initials, surname, equivalent words and phonetic codes."""
    named = _canonical(spark, d).select("record_id", T.normalize_text(F.col("person_name")).alias("norm_text"), T.name_tokens(F.col("person_name")).alias("t"))
    t = F.col("t")
    return named.select(
        "record_id", "norm_text", F.array_join(t, " ").alias("norm_name"), T.initials(t).alias("initials"), T.surname(t).alias("surname"), T.first_initial(t).alias("first_initial"),
        F.array_join(F.array_sort(T.alias_tokens(t)), " ").alias("aliases"), F.array_join(F.array_sort(T.phonetic_codes(t)), " ").alias("codes"),
    )


@query(f"""WITH {_RECORDS}, n AS (SELECT record_id, phone, {S.normalize_text('address')} AS norm_text FROM records), a AS (SELECT record_id, coalesce({S.normalize_address('norm_text')}, '') AS norm_address, {S.normalize_phone('phone')} AS norm_phone FROM n)
SELECT record_id, norm_address, {S.address_block('norm_address')} AS block_key, {S.city_hint('norm_address')} AS city, 'ADDR-' || sha1(norm_address)[1:12] AS address_id, norm_phone, '***' || right(norm_phone, 4) AS masked FROM a""")
def normalized_addresses(spark, d):
    """Addresses and phones normalized, with block key, city, id and mask."""
    a = _canonical(spark, d).select("record_id", T.normalize_address(F.col("address")).alias("norm_address"), T.normalize_phone(F.col("phone")).alias("norm_phone"))
    return a.select("record_id", "norm_address", T.address_block(F.col("norm_address")).alias("block_key"), T.city_hint(F.col("norm_address")).alias("city"), T.stable_id("ADDR", F.col("norm_address")).alias("address_id"), "norm_phone", T.mask_phone(F.col("norm_phone")).alias("masked"))


# --- resolution over the earlier run's fingerprints ---------------------------------------------------

_PRINTS = f"prints AS (SELECT record_id, phone, city, block_key, coalesce(norm_name, '') AS norm_name, {S.name_tokens(S.normalize_text('norm_name'))} AS tokens FROM record_fingerprints WHERE coalesce(person_name, '') <> '')"
_KEYS = """keyed AS (SELECT record_id, phone, city, block_key, coalesce(tokens[-1], '') AS last, coalesce(tokens[1][1:1], '') AS first FROM prints)"""


def _prints(spark, d):
    rows = table(spark, d, "record_fingerprints").filter(F.coalesce("person_name", F.lit("")) != "")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("norm_name", "norm_address", "block_key", "phone", "city")})


_PAIRS = """pairs AS (SELECT a.record_id AS left_id, b.record_id AS right_id FROM keyed a JOIN keyed b ON a.record_id < b.record_id AND ((a.phone = b.phone AND a.phone <> '') OR (a.city = b.city AND a.city <> '' AND a.last = b.last AND a.last <> '') OR (a.block_key = b.block_key AND a.block_key <> '') OR (a.first = b.first AND a.first <> '' AND a.last = b.last AND a.last <> '') OR (a.city = b.city AND a.city <> '' AND a.first = b.first AND a.first <> '')))"""


@query(f"WITH {_PRINTS}, {_KEYS}, {_PAIRS} SELECT left_id, right_id FROM pairs")
def candidate_pairs(spark, d):
    """Pairs of fingerprints that share a blocking key."""
    return resolve.candidate_pairs(_prints(spark, d))


@query(f"WITH {_PRINTS}, {_KEYS}, {_PAIRS}, c AS (SELECT (SELECT count(*) FROM prints) AS n, (SELECT count(*) FROM pairs) AS c) SELECT n AS records, cast(n * (n - 1) / 2 AS bigint) AS all_pairs, c AS candidate_pairs, cast(floor((1 - c / (n * (n - 1) / 2)) * 10000 + 0.5) AS bigint) AS reduction_bp FROM c")
def blocking_stats(spark, d):
    """How many pairs blocking leaves of all."""
    return resolve.runtime_stats(_prints(spark, d))


@query()
def pair_scores(spark, d):
    """Confidence, decision and reasons of every candidate pair."""
    scored = resolve.reasons(scores.scores(_prints(spark, d)))
    return scored.select("left_id", "right_id", "confidence", "decision", F.round("name_score", 3).alias("name_score"), F.round("address_score", 3).alias("address_score"), F.array_join("reasons", "; ").alias("reasons"))


_SIM = f"""sides AS (SELECT record_id, {S.alias_tokens('tokens')} AS aliases, list_filter(list_distinct(list_transform(tokens, lambda w: {S.phonetic_code('w')})), lambda c: c <> '') AS codes FROM (SELECT record_id, {S.name_tokens(S.normalize_text("coalesce(norm_name, '')"))} AS tokens FROM record_fingerprints))"""


def _jaccard(c: str) -> str:
    inter = f"len(list_intersect(l.{c}, r.{c}))"
    return f"cast(floor(CASE WHEN len(l.{c}) > 0 AND len(r.{c}) > 0 THEN {inter} / len(list_distinct(list_concat(l.{c}, r.{c}))) ELSE 0 END * 1000 + 0.5) AS bigint)"


@query(f"WITH {_SIM} SELECT left_record_id, right_record_id, decision, {_jaccard('aliases')} AS token_jaccard, {_jaccard('codes')} AS phonetic FROM match_pairs p JOIN sides l ON l.record_id = p.left_record_id JOIN sides r ON r.record_id = p.right_record_id")
def pair_similarities(spark, d):
    """Set similarities of the names of the earlier run's pairs, in thousandths."""
    t = T.name_tokens(F.coalesce("norm_name", F.lit("")))
    sides = table(spark, d, "record_fingerprints").select("record_id", T.alias_tokens(t).alias("aliases"), T.phonetic_codes(t).alias("codes"))
    side = lambda s: sides.select(*[F.col(c).alias(f"{s}_{c}") for c in sides.columns])
    pairs = table(spark, d, "match_pairs").join(side("l"), F.col("left_record_id") == F.col("l_record_id")).join(side("r"), F.col("right_record_id") == F.col("r_record_id"))
    as_int = lambda c: F.floor(T.jaccard(F.col(f"l_{c}"), F.col(f"r_{c}")) * 1000 + 0.5).cast("bigint")
    return pairs.select("left_record_id", "right_record_id", "decision", as_int("aliases").alias("token_jaccard"), as_int("codes").alias("phonetic"))


_WALK = """WITH RECURSIVE e AS (
  SELECT left_record_id AS a, right_record_id AS b FROM match_pairs WHERE decision = 'match'
  UNION SELECT right_record_id, left_record_id FROM match_pairs WHERE decision = 'match'
), walk AS (SELECT record_id AS a, record_id AS b FROM record_fingerprints UNION SELECT walk.a, e.b FROM walk JOIN e ON e.a = walk.b),
c AS (SELECT min(b) AS component, a AS record_id FROM walk GROUP BY a)"""


def _earlier_clusters(spark, d):
    matches = table(spark, d, "match_pairs").filter("decision = 'match'")
    return components.components(table(spark, d, "record_fingerprints").select("record_id"), matches, "record_id", "left_record_id", "right_record_id")


@query(_WALK + """, s AS (SELECT component, count(*) AS size FROM c GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS k FROM s)
SELECT record_id, 'ENT-' || CASE WHEN k < 10000 THEN lpad(cast(k AS varchar), 4, '0') ELSE cast(k AS varchar) END AS entity_id, size FROM c JOIN n USING (component)""")
def numbered_clusters(spark, d):
    """Each fingerprint with the number of its cluster, the largest first."""
    of = cut(_earlier_clusters(spark, d))
    numbered = resolve.number(of.groupBy("component").agg(F.count("*").alias("size")), "size", "component")
    return of.join(numbered, "component").select("record_id", "entity_id", "size")


@query()
def entities(spark, d):
    """Entities by pair scoring over the fingerprints: name, size, addresses, phones."""
    prints = cut(_prints(spark, d))
    found = resolve.entities(prints, links.clusters(prints))
    return found.select("entity_id", "canonical_name", "size", F.array_join("addresses", " | ").alias("addresses"), F.array_join("phones", " | ").alias("phones"))


@query("SELECT left_record_id AS left_id, right_record_id AS right_id, confidence FROM match_pairs WHERE decision = 'possible' GROUP BY ALL ORDER BY confidence DESC NULLS LAST, left_id, right_id LIMIT 100")
def top_possible(spark, d):
    """The hundred best possible matches: a top-k report."""
    pairs = table(spark, d, "match_pairs").select(F.col("left_record_id").alias("left_id"), F.col("right_record_id").alias("right_id"), "confidence", "decision").distinct()
    return resolve.top_possible(pairs).drop("decision")


# --- evaluation, graph, aggregates: entities by normalized name -------------------------------------------

_OWNED = f"""{_RECORDS}, named AS (SELECT *, {S.normalize_text('person_name')} AS nt, {S.normalize_text('address')} AS address_text FROM records), tok AS (SELECT *, {S.joined(S.name_tokens('nt'))} AS norm_name FROM named),
owned AS (SELECT *, 'ENT:' || norm_name AS entity_id, coalesce({S.normalize_address('address_text')}, '') AS norm_address, {S.normalize_phone('phone')} AS norm_phone FROM tok WHERE norm_name <> '')"""


def _owned(spark, d):
    records = _canonical(spark, d)
    name = T.normalize_name(F.col("person_name"))
    of = records.withColumn("norm_name", name).filter("norm_name <> ''").withColumn("entity_id", F.concat(F.lit("ENT:"), F.col("norm_name")))
    return of.withColumns({"norm_address": T.normalize_address(F.col("address")), "norm_phone": T.normalize_phone(F.col("phone"))})


@query(f"""WITH {_RECORDS}, l AS (SELECT t.ntn AS truth, {S.joined(S.name_tokens(S.normalize_text('t.full_name')))} AS entity FROM fbr_tax_records_complex t WHERE ntn IS NOT NULL AND ntn <> 'NTN-AGT-0001'),
k AS (SELECT *, row_number() OVER () AS i FROM l), p AS (SELECT a.truth = b.truth AS t, a.entity = b.entity AS e FROM k a JOIN k b ON a.i < b.i),
c AS (SELECT count_if(t AND e) AS tp, count_if(e AND NOT t) AS fp, count_if(t AND NOT e) AS fn, count_if(NOT t AND NOT e) AS tn FROM p)
SELECT *, cast(floor(tp / (tp + fp) * 1000 + 0.5) AS bigint) AS precision, cast(floor(tp / (tp + fn) * 1000 + 0.5) AS bigint) AS recall, cast(floor(2 * tp / (2 * tp + fp + fn) * 1000 + 0.5) AS bigint) AS f1 FROM c""")
def pairwise_quality(spark, d):
    """How well equal names find equal taxpayers, over all pairs of labelled tax rows; in thousandths."""
    tax = table(spark, d, "fbr_tax_records_complex").filter("ntn is not null and ntn <> 'NTN-AGT-0001'")
    out = resolve.evaluate_pairwise(tax.select(F.col("ntn").alias("truth"), T.normalize_name(F.col("full_name")).alias("entity")))
    return out.withColumns({c: F.floor(F.col(c) * 1000 + 0.5).cast("bigint") for c in ("precision", "recall", "f1")})


_EDGES = f"""edges AS (
SELECT entity_id AS source, 'ADDR-' || sha1(norm_address)[1:12] AS target, 'USES_ADDRESS' AS relation, 0.8::double AS confidence, record_id FROM owned WHERE norm_address <> ''
UNION ALL SELECT entity_id, 'PHONE-' || sha1(norm_phone)[1:12], 'USES_PHONE', 0.95, record_id FROM owned WHERE norm_phone <> ''
{''.join(f"UNION ALL SELECT entity_id, '{p}' || {f"coalesce(nullif({c}, ''), record_id)" if c else 'record_id'}, '{r}', {w}, record_id FROM owned WHERE record_type = '{k}' " for k, (_, p, c, r, w) in graph.ASSETS.items())})"""


@query(f"WITH {_OWNED}, {_EDGES} SELECT * FROM edges")
def graph_edges(spark, d):
    """Edges from entities to addresses, phones and assets, one per record and evidence."""
    return graph.edges(_owned(spark, d))


def _nodes_sql() -> str:
    parts = ["SELECT 'ADDR-' || sha1(norm_address)[1:12] AS node_id, 'Address' AS node_type, address AS label, record_id FROM owned WHERE norm_address <> ''", "SELECT 'PHONE-' || sha1(norm_phone)[1:12], 'PhoneNumber', '***' || right(norm_phone, 4), record_id FROM owned WHERE norm_phone <> ''"]
    for kind, (node, prefix, column, _, _) in graph.ASSETS.items():
        own = f"coalesce(nullif({column}, ''), record_id)" if column else "record_id"
        label = {"tax": "'Return ' || coalesce(nullif(filer_status, ''), 'Unknown')", "vehicle": "coalesce(nullif(vehicle_make_model, ''), 'Vehicle')", "utility": "coalesce(nullif(meter_ref_no, ''), 'Meter')", "property": "coalesce(nullif(property_type, ''), 'Property')"}[kind]
        parts.append(f"SELECT '{prefix}' || {own}, '{node}', {label}, record_id FROM owned WHERE record_type = '{kind}'")
    return f"all_nodes AS ({' UNION ALL '.join(parts)}), nodes AS (SELECT DISTINCT entity_id AS node_id, 'Person' AS node_type, norm_name AS label FROM owned UNION ALL SELECT node_id, node_type, arg_min(label, record_id) FROM all_nodes GROUP BY 1, 2)"


@query(f"WITH {_OWNED}, {_nodes_sql()} SELECT * FROM nodes")
def graph_nodes(spark, d):
    """Nodes of the evidence graph; the first record that mentions a node names it."""
    of = _owned(spark, d)
    return graph.nodes(of, of.select("entity_id", F.col("norm_name").alias("canonical_name")).distinct())


_LINKS = """links AS (
SELECT a.entity_id AS source, b.entity_id AS target, 'SAME_ADDRESS_AS' AS relation, 0.75::double AS confidence, a.norm_address AS shared_value FROM (SELECT DISTINCT norm_address, entity_id FROM owned WHERE norm_address <> '') a JOIN (SELECT DISTINCT norm_address, entity_id FROM owned WHERE norm_address <> '') b ON a.norm_address = b.norm_address AND a.entity_id <> b.entity_id
UNION ALL SELECT a.entity_id, b.entity_id, 'SHARES_PHONE_WITH', 0.95, a.norm_phone FROM (SELECT DISTINCT norm_phone, entity_id FROM owned WHERE norm_phone <> '') a JOIN (SELECT DISTINCT norm_phone, entity_id FROM owned WHERE norm_phone <> '') b ON a.norm_phone = b.norm_phone AND a.entity_id <> b.entity_id)"""


def _usable(of):
    """Placeholders of addresses and phones would join everyone with everyone; they are words, not places."""
    return of.withColumn("norm_address", F.when(F.col("norm_address").rlike("[0-9]"), F.col("norm_address")).otherwise("")).withColumn("norm_phone", F.when(F.col("norm_phone").rlike("^03[0-9]{9}$"), F.col("norm_phone")).otherwise(""))


_USABLE = _OWNED.replace("owned AS (SELECT", "owned_all AS (SELECT") + ", owned AS (SELECT * EXCLUDE (norm_address, norm_phone), CASE WHEN regexp_matches(norm_address, '[0-9]') THEN norm_address ELSE '' END AS norm_address, CASE WHEN regexp_full_match(norm_phone, '03[0-9]{9}') THEN norm_phone ELSE '' END AS norm_phone FROM owned_all)"


@query(f"WITH {_USABLE}, {_LINKS} SELECT * FROM links")
def associations(spark, d):
    """Entities that share an address with a digit or a mobile number, in both directions; a part of ``associations_all``."""
    return graph.associations(_usable(_owned(spark, d)))


@query(f"WITH {_OWNED}, {_LINKS} SELECT * FROM links")
def associations_all(spark, d):
    """Entities that share any non-empty address or phone, in both directions."""
    return graph.associations(_owned(spark, d))


@query(f"WITH {_OWNED}, {_EDGES}, {_nodes_sql()} SELECT count(*) AS nodes, count_if(node_type = 'Person') AS persons, count_if(node_type IN ('Vehicle', 'Property', 'Meter')) AS assets, (SELECT count(*) FROM edges) AS edges FROM nodes")
def graph_summary(spark, d):
    return graph.graph_summary(graph_nodes(spark, d), graph_edges(spark, d))


@query(f"WITH {_OWNED}, {_EDGES} SELECT * FROM edges WHERE source = 'ENT:farzana kazmi'")
def ego_network(spark, d):
    """Edges around one entity."""
    return graph.ego(graph_edges(spark, d), "ENT:farzana kazmi")


_AGG = """agg AS (SELECT entity_id, count(*) AS records, max(CASE WHEN declared_income > 0 THEN declared_income END) AS declared_income, coalesce(sum(tax_paid), 0.0) AS tax_paid, count_if(record_type = 'tax') AS tax_records, count_if(record_type = 'vehicle') AS vehicles, count_if(record_type = 'utility') AS meters, count_if(record_type = 'property') AS properties,
coalesce(sum(property_value), 0.0) AS property_value, coalesce(sum(monthly_bill), 0.0) AS monthly_bill, coalesce(max(engine_capacity_cc), 0.0) AS max_engine_cc, coalesce(string_agg(DISTINCT lower(filer_status), ',' ORDER BY lower(filer_status)), '') AS filer_statuses FROM owned GROUP BY entity_id)"""


@query(f"WITH {_OWNED}, {_AGG} SELECT * REPLACE (cast(floor(tax_paid + 0.5) AS bigint) AS tax_paid, cast(floor(property_value + 0.5) AS bigint) AS property_value, cast(floor(monthly_bill + 0.5) AS bigint) AS monthly_bill) FROM agg")
def entity_aggregates(spark, d):
    """Counts and sums of each entity's records."""
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("bigint")
    return graph.entity_aggregate(_owned(spark, d)).withColumns({c: whole(c) for c in ("tax_paid", "property_value", "monthly_bill")})


@query(f"WITH {_OWNED}, {_AGG}, s AS (SELECT avg(monthly_bill) AS m, stddev_pop(monthly_bill) AS s, avg(property_value) AS m2, stddev_pop(property_value) AS s2 FROM agg) SELECT entity_id, cast(floor((monthly_bill - m) / s * 1000 + 0.5) AS bigint) AS z_monthly_bill, cast(floor((property_value - m2) / s2 * 1000 + 0.5) AS bigint) AS z_property_value FROM agg, s")
def peer_z_scores(spark, d):
    """Distance from the mean of all entities, in thousandths of a standard deviation."""
    z = graph.z_scores(graph.entity_aggregate(_owned(spark, d)), ["monthly_bill", "property_value"])
    return z.withColumns({c: F.floor(F.col(c) * 1000 + 0.5).cast("bigint") for c in ("z_monthly_bill", "z_property_value")})


@query(f"WITH {_USABLE}, {_AGG}, {_LINKS} SELECT l.source AS entity_id, cast(floor(sum(a.property_value * l.confidence) + 0.5) AS bigint) AS exposure, max(l.confidence) AS strongest, count(*) AS links FROM links l JOIN agg a ON a.entity_id = l.target WHERE a.property_value > 0 GROUP BY 1")
def neighbour_exposure(spark, d):
    """Property of the entities that one is associated with by ``associations``, weighted by the links."""
    return _exposure(_usable(_owned(spark, d)))


@query(f"WITH {_OWNED}, {_AGG}, {_LINKS} SELECT l.source AS entity_id, cast(floor(sum(a.property_value * l.confidence) + 0.5) AS bigint) AS exposure, max(l.confidence) AS strongest, count(*) AS links FROM links l JOIN agg a ON a.entity_id = l.target WHERE a.property_value > 0 GROUP BY 1")
def neighbour_exposure_all(spark, d):
    """Property of the entities that one is associated with by ``associations_all``, weighted by the links."""
    return _exposure(_owned(spark, d))


def _exposure(of):
    out = graph.neighbour_exposure(graph.associations(of), graph.entity_aggregate(of), "property_value")
    return out.withColumn("exposure", F.floor(F.col("exposure") + 0.5).cast("bigint"))


@query(_WALK + """, b AS (SELECT l.component AS entity_id, r.component AS other, max(confidence) AS confidence FROM match_pairs p JOIN c l ON l.record_id = p.left_record_id JOIN c r ON r.record_id = p.right_record_id WHERE decision = 'possible' AND confidence IS NOT NULL AND l.component <> r.component GROUP BY 1, 2),
u AS (SELECT entity_id, other, confidence FROM b UNION ALL SELECT other, entity_id, confidence FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, other) AS k FROM u)
SELECT entity_id, count(*) AS possible, string_agg(other, ' ' ORDER BY k) FILTER (k <= 8) AS others FROM n GROUP BY 1""")
def possible_matches(spark, d):
    """Possible matches between clusters of the earlier run, from both sides, the best eight listed."""
    of = _earlier_clusters(spark, d).withColumnRenamed("component", "entity_id")
    pairs = table(spark, d, "match_pairs").filter("decision = 'possible' and confidence is not null").select(F.col("left_record_id").alias("left_id"), F.col("right_record_id").alias("right_id"), "confidence")
    l, r = of.select(F.col("record_id").alias("left_id"), F.col("entity_id").alias("l")), of.select(F.col("record_id").alias("right_id"), F.col("entity_id").alias("r"))
    best = pairs.join(l, "left_id").join(r, "right_id").filter("l <> r").groupBy("l", "r").agg(F.max("confidence").alias("confidence"))
    named = best.select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), "confidence")
    itself = of.select(F.col("entity_id").alias("record_id"), "entity_id").distinct()
    return graph.possible_of_entities(named, itself).withColumn("others", F.array_join("others", " "))


@query(f"WITH {_OWNED} SELECT entity_id, string_agg(record_id, ' ' ORDER BY record_id) AS records FROM owned GROUP BY 1")
def lineage(spark, d):
    """The source rows behind each entity."""
    return graph.lineage(_owned(spark, d)).select("entity_id", F.array_join(F.transform("rows", lambda r: r["record_id"]), " ").alias("records"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return entity_aggregates(spark, d)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
