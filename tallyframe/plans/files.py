"""Source and sink queries: the given tables are written in the source layouts and read back strictly.

Everything is written below a fresh path of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.contract import TRANSACTIONS, USERS as USER_TABLE
from tallyframe.functions.convert import convert
from tallyframe.operators import quality, warehouse
from tallyframe.plans import star
from tallyframe.plans.raw import cards_source, transactions_source, users_source
from tallyframe.plans.registry import query
from tallyframe.plans.star import CARDS, sql
from tallyframe.session import fresh_path, materialise
from tallyframe.sources import files, publish, readers


def _write_csv(df, path: str) -> str:
    df.write.options(header=True, quote='"', escape='"').csv(path)
    return path


@query("src_strict_csv", """
    select cast(o_orderkey as varchar) as id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as date,
           '$' || cast(cast(o_totalprice as decimal(18,2)) as varchar) as amount,
           'a "quoted", ' || o_orderpriority as use_chip, cast(null as varchar) as errors from orders""")
def src_strict_csv(spark, folder):
    """Quotes doubled, separators inside quotes, empty fields as NULL."""
    awkward = transactions_source(spark, folder).withColumns({
        "use_chip": F.concat(F.lit('a "quoted", '), "use_chip"), "errors": F.lit(None).cast("string")})
    path = _write_csv(awkward, fresh_path(spark, "csv"))
    return readers.read_strict(spark, path, TRANSACTIONS).select("id", "date", "amount", "use_chip", "errors")


@query("src_header_check", """
    select 'drifted' as part, 'renamed_age' as header_column, cast(1 as bigint) as position
    where exists (select 1 from customer)""")
def src_header_check(spark, folder):
    """One export follows the contract, one has a renamed column; only the second is reported."""
    source = users_source(spark, folder)
    path = fresh_path(spark, "headers")
    _write_csv(source, f"{path}/good")
    _write_csv(source.withColumnRenamed("current_age", "renamed_age"), f"{path}/drifted")
    drift = files.header_drift(files.list_files(spark, path, "*.csv"), USER_TABLE.raw_names)
    declared = F.array(*[F.lit(c) for c in USER_TABLE.raw_names])
    columns = drift.select(F.regexp_extract("path", "/(good|drifted)/", 1).alias("part"), F.posexplode("header"))
    return columns.where(~F.element_at(declared, F.col("pos") + 1).eqNullSafe(F.col("col"))).select(
        "part", F.col("col").alias("header_column"), F.col("pos").cast("long").alias("position")).distinct()


@query("src_json_map", """
    select lpad(cast(p_partkey % 10000 as varchar), 4, '0') as mcc, min(p_name) as description from part group by 1""")
def src_json_map(spark, folder):
    """Each file is one JSON object of four-digit keys; key ranges keep the objects small."""
    number = F.col("p_partkey") % 10000
    entries = star.table(spark, folder, "part").groupBy(number.alias("number")).agg(F.min("p_name").alias("p_name")).select(
        F.lpad(F.col("number").cast("string"), 4, "0").alias("mcc"), "p_name", F.floor(F.col("number") / 500).alias("block"))
    objects = entries.groupBy("block").agg(F.to_json(F.map_from_entries(
        F.collect_list(F.struct("mcc", "p_name")))).alias("value"))
    path = fresh_path(spark, "json-map")
    # one object per file
    objects.repartitionByRange(20, "block").select("value").write.option(
        "maxRecordsPerFile", 1).text(path)
    return readers.read_json_map(spark, path)


@query("src_json_map_problems", """
    with entries as (
        select lpad(cast(p_partkey % 50 as varchar), 4, '0') as mcc, p_name as description from part
        union all select cast(p_size as varchar), p_name from part)
    select mcc, cast(count(*) as bigint) as entries, cast(0 as bigint) as blank_descriptions from entries
    group by 1 having count(*) > 1 or not regexp_full_match(mcc, '[0-9]{4}')""")
def src_json_map_problems(spark, folder):
    """Repeated keys survive the reader, so they can be reported instead of being overwritten."""
    part = star.table(spark, folder, "part")
    # a block covers 500 part numbers, so an object stays small however many parts there are
    block = F.floor(F.col("p_partkey") / 500).alias("block")
    entries = part.select(block, F.lpad((F.col("p_partkey") % 50).cast("string"), 4, "0").alias("mcc"), "p_name").unionByName(
        part.select(block, F.col("p_size").cast("string").alias("mcc"), "p_name"))
    path = fresh_path(spark, "json-map")
    member = F.concat(F.lit('"'), "mcc", F.lit('":"'), "p_name", F.lit('"'))
    objects = entries.groupBy("block").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(member), ","), F.lit("}")).alias("value"))
    objects.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.json_entry_problems(readers.json_entries(spark, path))


@query("src_jsonl", "select cast(doc_id as varchar) as doc_id, md5(text) as digest, lang as category from documents")
def src_jsonl(spark, folder):
    """JSON lines with blank lines between the records."""
    documents = star.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("category"), "text")
    path = fresh_path(spark, "jsonl")
    documents.select(F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value")).write.text(path)
    read = readers.read_json_lines(spark, path, "doc_id string, category string, text string")
    return read.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "category")


@query("src_manifest", """
    select cast(doc_id as varchar) as doc_id, source || '; ' || lang as entities, lang as category from documents""")
def src_manifest(spark, folder):
    """Every document is listed twice; the later line wins."""
    documents = star.table(spark, folder, "documents")

    def listed(position: int, entities: F.Column):
        return documents.select(
            F.lit(position).alias("position"), F.col("doc_id").cast("string").alias("doc_id"),
            F.col("lang").alias("category"), *[F.lit("x").alias(c) for c in ("doc_type", "format", "title", "date", "path")],
            F.lit("3").alias("word_count"), entities.alias("entities"), F.lit("a, b").alias("summary"))

    both = listed(0, F.lit("outdated")).unionByName(listed(1, F.concat("source", F.lit("; "), "lang")))
    path = fresh_path(spark, "manifest")
    _write_csv(both.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").drop("position"), path)
    return readers.read_manifest(spark, path).select("doc_id", "entities", "category")


@query("sink_typed_table", """
    select o_custkey as client_id, cast(count(*) as bigint) as row_count,
           cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as amount from orders group by 1""")
def sink_typed_table(spark, folder):
    typed = convert(transactions_source(spark, folder), TRANSACTIONS)
    written = publish.publish({TRANSACTIONS.source: typed}, fresh_path(spark, "typed"),
                              validate=lambda tables: quality.require_types(
                                  tables[TRANSACTIONS.source], TRANSACTIONS.source_schema(), TRANSACTIONS.source))
    return written[TRANSACTIONS.source].groupBy("client_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("amount").cast("decimal(38,2)").alias("amount"))


@query("sink_no_overwrite", """
    select true as refused, cast(count(*) as bigint) as kept_rows from customer""")
def sink_no_overwrite(spark, folder):
    path = fresh_path(spark, "published")
    users = star.users(spark, folder)
    publish.publish({"users": users}, path)
    try:
        publish.publish({"users": users.where("client_id < 0")}, path)
        refused = False
    except FileExistsError:
        refused = True
    return spark.read.parquet(f"{path}/users").agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("kept_rows"))


@query("src_fingerprint", """
    select 'nation-' || n_nationkey as file, cast(strlen(n_name) + 1 as bigint) as length, sha256(n_name || chr(10)) as sha256 from nation""")
def src_fingerprint(spark, folder):
    """One file per nation with its name as content."""
    nations = star.table(spark, folder, "nation").select(F.concat(F.lit("nation-"), "n_nationkey").alias("name"), F.col("n_name").alias("value"))
    path = fresh_path(spark, "nations")
    nations.repartition("name").write.partitionBy("name").text(path)
    found = files.fingerprints(files.list_files(spark, path, "*.txt"))
    return found.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("file"), "length", "sha256")


_PARTS = 16


@query("fingerprint_changes", f"""
    select distinct 'part=' || c_custkey % {_PARTS} as part, true as content_differs from customer where c_custkey % 5 = 1 and c_custkey % {_PARTS} < 4""")
def fingerprint_changes(spark, folder):
    """Two exports of many files; some files have changed values, and only their fingerprints differ."""
    source = users_source(spark, folder).withColumn("part", F.col("id").cast("long") % _PARTS)
    path = fresh_path(spark, "fingerprints")
    changed = (F.col("id").cast("long") % 5 == 1) & (F.col("part") < 4)
    for name, rows in (("before", source), ("after", source.withColumn("credit_score", F.when(changed, "1").otherwise(F.col("credit_score"))))):
        # one sorted file per part, so that equal content gives equal files
        rows.repartition(_PARTS, "part").sortWithinPartitions("part", "id").write.partitionBy("part").options(header=True, quote='"', escape='"').csv(f"{path}/{name}")

    def prints(name: str):
        return files.fingerprints(files.list_files(spark, f"{path}/{name}", "*.csv")).withColumn(
            "path", F.regexp_extract("path", "(part=[0-9]+)/", 1))

    return files.fingerprint_changes(prints("before"), prints("after")).select(
        F.col("path").alias("part"), (F.col("expected") != F.col("actual")).alias("content_differs"))


@query("src_rejects", """
    select 'part=' || o_orderkey % 4 as part, cast(count(*) as bigint) as records,
           cast(count(*) filter (where o_orderkey % 7 = 0) as bigint) as malformed from orders group by 1""")
def src_rejects(spark, folder):
    """Some records have a field too many; they are counted per file, and nothing of them is shown."""
    key = F.col("o_orderkey")
    line = F.concat_ws(",", key.cast("string"), F.col("o_orderstatus"), F.when(key % 7 == 0, "surplus"))
    path = fresh_path(spark, "rejects")
    rows = star.table(spark, folder, "orders").select((key % 4).alias("part"), key, line.alias("value"))
    head = spark.range(4).select(F.col("id").alias("part"), F.lit(-1).cast("long").alias("o_orderkey"), F.lit("id,status").alias("value"))
    rows.unionByName(head).repartition(4, "part").sortWithinPartitions("part", "o_orderkey").select(
        "value", "part").write.partitionBy("part").text(path)
    counts = readers.rejects(spark, [f"{path}/part={i}" for i in range(4)], ["id", "status"])
    return counts.groupBy(F.regexp_extract("file", "(part=[0-9]+)/", 1).alias("part")).agg(
        F.sum("records").alias("records"), F.sum("malformed").alias("malformed"))


@query("sink_copy_verify", """
    select cast(0 as bigint) as missing_in_copy, cast(0 as bigint) as extra_in_copy,
           cast(count(*) as bigint) as copied_rows from lineitem""")
def sink_copy_verify(spark, folder):
    """Copy, reopen, compare row by row; the derived facts contain repeated rows."""
    facts = star.transactions(spark, folder)
    copy = publish.publish({"facts": facts}, fresh_path(spark, "copy"))["facts"]
    copied = copy.agg(F.count(F.lit(1)).alias("value")).select(F.lit("copied_rows").alias("name"), "value")
    differences = quality.unpivot(publish.copy_differences(facts, copy), "name", "value")
    names = ["missing_in_copy", "extra_in_copy", "copied_rows"]
    return differences.unionByName(copied).agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


@query("sink_report", sql(CARDS) + """
    select 'cards' as table_name, 'row_count' as check_name, cast(count(*) as varchar) as value from cards
    union all select 'cards', 'credit_limits', cast(sum(credit_limit) as varchar) from cards""")
def sink_report(spark, folder):
    counts = star.cards(spark, folder).agg(F.count(F.lit(1)).alias("row_count"), F.sum("credit_limit").alias("credit_limits"))
    path = fresh_path(spark, "report")
    publish.write_report(quality.as_report(counts, "cards"), path)
    return spark.read.schema("table_name string, check_name string, value string").json(path)


@query("export_json_safe", sql(CARDS) + """
    select '{"card_id":' || card_id || ',"credit_limit":' || cast(cast(credit_limit as double) as varchar)
           || ',"account_open":"' || strftime(account_open, '%Y-%m-%dT%H:%M:%S') || '","opened":"'
           || strftime(account_open, '%Y-%m-%d') || '","tags":["' || card_type || '","' || card_brand || '"],"note":null}' as row
    from cards""")
def export_json_safe(spark, folder):
    cards = star.cards(spark, folder).select(
        "card_id", "credit_limit", "account_open", F.col("account_open").cast("date").alias("opened"),
        F.array("card_type", "card_brand").alias("tags"), F.lit(None).cast("string").alias("note"))
    return publish.json_rows(cards)


@query("prepare_warehouse", """
    select 'users_data' as table_name, 'row_count' as check_name, cast(count(*) as varchar) as value from customer
    union all select 'transactions_data', 'row_count', cast(count(*) as varchar) from orders
    union all select 'cards_data', 'row_count', cast(count(*) as varchar) from orders
    union all select 'transactions_data', 'net_amount',
           cast(cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as varchar) from orders
    union all select 'relationships', 'cards_without_users', '0'
    union all select 'relationships', 'transaction_card_owner_mismatches', '0'
    union all select 'sources', 'stale_refused', 'true'""")
def prepare_warehouse(spark, folder):
    """The whole import: headers, approved fingerprints, conversion, validation, one publication."""
    base = fresh_path(spark, "import")
    codes = F.lpad((F.col("p_partkey") % 120).cast("string"), 4, "0")
    _write_csv(transactions_source(spark, folder), warehouse.source_path(base, "transactions"))
    _write_csv(cards_source(spark, folder), warehouse.source_path(base, "cards"))
    _write_csv(users_source(spark, folder), warehouse.source_path(base, "users"))
    lookup = star.table(spark, folder, "part").groupBy(codes.alias("mcc")).agg(F.min("p_name").alias("description"))
    lookup.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("mcc", "description")))).alias("value")).coalesce(1).write.text(
        warehouse.source_path(base, "mcc_codes"))
    approved = materialise(warehouse.source_fingerprints(spark, base), "approved")
    counts = spark.createDataFrame([("users_data", star.table(spark, folder, "customer").count())], "table_name string, row_count long")
    stale = approved.withColumn("sha256", F.reverse("sha256"))
    try:
        warehouse.prepare(spark, base, f"{base}-refused", approved_fingerprints=stale)
        refused = False
    except ValueError:
        refused = not publish.exists(spark, f"{base}-refused")
    report = warehouse.prepare(spark, base, f"{base}-warehouse", approved_fingerprints=approved, approved_rows=counts)
    wanted = F.col("check_name").isin("row_count") & (F.col("table_name") != "mcc_codes")
    named = F.concat_ws(".", "table_name", "check_name").isin(
        "transactions_data.net_amount", "relationships.cards_without_users", "relationships.transaction_card_owner_mismatches")
    shown = report.where(wanted | named).select("table_name", "check_name", "value")
    return shown.unionByName(spark.range(1).select(
        F.lit("sources").alias("table_name"), F.lit("stale_refused").alias("check_name"), F.lit(str(refused).lower()).alias("value")))
