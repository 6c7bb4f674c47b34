"""The registered queries, each with the SQL that checks it where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.config import Names, path_exists, ship_package, use_database, work_folder
from turnwise.functions import text
from turnwise.functions.models import (
    DigestModel,
    ExtractiveAssessor,
    HashEmbedder,
    LastMessageModel,
    RewriteOrDigest,
    embed,
)
from turnwise.functions.nested import (
    all_but_last,
    append_frames,
    fill_template,
    first_or_null,
    flatten,
    json_schema_of,
    last_or_null,
)
from turnwise.operators import assess, changes, chat, search, transcript
from turnwise.operators.distribution import spread_join, stored, use_all_cores
from turnwise.operators.index import (
    EMBEDDING,
    PK,
    Index,
    build_index,
    check_dimension,
    create_or_sync,
    keyword_index,
    open_index,
    posting_rows,
    term_counts,
    vector_norm,
)
from turnwise.plans import derived
from turnwise.plans.derived import table
from turnwise.schemas import PARTICIPANT_KEYS, PARTICIPANT_TEXT_LISTS
from turnwise.sources.calls import parse_calls, read_calls, read_inferred, sentence_rows
from turnwise.sources.tables import (
    append_batch,
    create_table,
    preview,
    read_batches,
    replace_table,
    row_count,
    scan,
    stream_table,
)
from turnwise.streaming.embedding import append_stream, embed_stream, participant_content as contents_of, read_vectors, sync_vectors

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIM = 64
K = 10
EMBEDDER = HashEmbedder(DIM)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


# --- sources, sinks, plain table work ---------------------------------------------------------


@query("SELECT conv_id, turn, role, text FROM conversations")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/conversations.parquet")


@query("SELECT count(DISTINCT conv_id) AS n_rows FROM conversations")
def count_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count(table(spark, sf_dir, "conversations").select("conv_id").distinct())


@query("SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn LIMIT 5")
def preview_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(table(spark, sf_dir, "conversations"), 5, "conv_id", "turn")


@query(
    """
    SELECT doc_id, lang, NULL::INTEGER AS quality, NULL::INTEGER AS toxic FROM documents
    UNION ALL SELECT doc_id, NULL, quality, toxic FROM labels
    """
)
def append_with_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return append_frames(documents, table(spark, sf_dir, "labels"))


@query(
    """
    SELECT doc_id, quality, toxic, NULL AS lang FROM labels
    UNION ALL SELECT doc_id, NULL, NULL, lang FROM documents
    """
)
def merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches with different columns in one sink; the second is written twice and counts once."""
    folder = work_folder(spark, "merged")
    append_batch(table(spark, sf_dir, "labels"), folder, 0)
    for _ in range(2):
        append_batch(table(spark, sf_dir, "documents").select("doc_id", "lang"), folder, 1)
    return read_batches(spark, folder).select("doc_id", "quality", "toxic", "lang")


@query(
    """
    SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY o_custkey
    """
)
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by an aggregate of itself, with other columns."""
    folder = work_folder(spark, "table")
    name = "turnwise_" + folder.rsplit("-", 1)[1]
    replace_table(table(spark, sf_dir, "orders"), name, folder)
    totals = spark.table(name).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    replace_table(totals, name, folder)
    return scan(spark, name)


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read as a stream, drained into another; a second run finds nothing new."""
    schema = table(spark, sf_dir, "events").schema
    folder = work_folder(spark, "stream")
    for _ in range(2):
        stream = stream_table(spark, sf_dir, schema, files="events.parquet")
        append_stream(
            stream.select("event_id", "user_id", "event_type", "value"),
            f"{folder}/sink",
            f"{folder}/checkpoint",
        )
    return spark.read.parquet(f"{folder}/sink")


HASHED_TERMS_SQL = r"""
    SELECT {id} AS id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS c
    FROM (SELECT {id}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')) AS term FROM {table})
    GROUP BY 1, 2
"""
# A vector value is stored in single precision.
HASHED_VECTORS_SQL = """
    SELECT id, bucket, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS v
    FROM ({terms})
"""


def hashed_vectors(name: str, id_col: str, text: str = "text") -> str:
    return HASHED_VECTORS_SQL.format(terms=HASHED_TERMS_SQL.format(table=name, id=id_col, text=text))


@query(
    f"""
    WITH texts AS (SELECT text, sha256(length(source) || ':' || source || ',' || length(text) || ':' || text) AS id
                   FROM documents),
    vec AS ({hashed_vectors("(SELECT DISTINCT id, text FROM texts)", "id")})
    SELECT id, bucket, round(v, 6) AS weight FROM vec
    """
)
def stream_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows of a stream get an id and a vector; a copy of a row is embedded once."""
    schema = table(spark, sf_dir, "documents").schema
    folder = work_folder(spark, "vectors")
    for _ in range(2):
        stream = stream_table(spark, sf_dir, schema, files="documents.parquet")
        embed_stream(
            stream.select("source", "text"),
            f"{folder}/sink",
            f"{folder}/checkpoint",
            EMBEDDER,
            ["source", "text"],
            text="text",
        )
    return _nonzero_weights(read_vectors(spark, f"{folder}/sink"), "id")


@query(
    f"""
    WITH texts AS (SELECT CASE WHEN lang = 'en' THEN text || ' ' || source ELSE text END AS text,
                          sha256(length(k) || ':' || k) AS id
                   FROM (SELECT *, CAST(doc_id AS VARCHAR) AS k FROM documents WHERE lang <> 'de')),
    vec AS ({hashed_vectors("(SELECT id, text FROM texts)", "id")})
    SELECT id, bucket, round(v, 6) AS weight FROM vec
    """
)
def stream_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is replaced between two runs: rows that left it, changed or came are so in the sink."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "source", "lang", "text")
    longer = F.when(F.col("lang") == "en", F.concat("text", F.lit(" "), "source")).otherwise(F.col("text"))
    folder = work_folder(spark, "replaced-source")
    for state in (documents.filter("lang <> 'fr'"), documents.filter("lang <> 'de'").withColumn("text", longer)):
        state.select("key", "text").write.mode("overwrite").parquet(f"{folder}/source")
        stream = stream_table(spark, f"{folder}/source", state.select("key", "text").schema)
        embed_stream(stream, f"{folder}/sink", f"{folder}/checkpoint", EMBEDDER, ["key"], text="text")
        sync_vectors(spark.read.parquet(f"{folder}/source"), f"{folder}/sink", EMBEDDER, ["key"], text="text")
    return _nonzero_weights(read_vectors(spark, f"{folder}/sink"), "id")


def _nonzero_weights(df: DataFrame, id_col: str) -> DataFrame:
    weights = df.select(id_col, F.posexplode(EMBEDDING).alias("bucket", "value"))
    return weights.filter("value <> 0").select(
        id_col,
        F.col("bucket").cast("long").alias("bucket"),
        F.round(F.col("value").cast("double"), 6).alias("weight"),
    )


@query(
    """
    WITH old AS (SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS price
                 FROM orders WHERE o_orderdate < DATE '1998-01-01'),
    new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END
                   AS o_orderstatus, round(o_totalprice, 2) AS price
            FROM orders WHERE o_orderdate >= DATE '1994-01-01')
    SELECT coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey,
           CASE WHEN old.o_orderkey IS NULL THEN 'insert' WHEN new.o_orderkey IS NULL THEN 'delete'
                ELSE 'update' END AS change
    FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey
    WHERE old.o_orderkey IS NULL OR new.o_orderkey IS NULL OR old.o_custkey <> new.o_custkey
       OR old.o_orderstatus <> new.o_orderstatus OR old.price <> new.price
    """
)
def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the orders: up to 1997, and from 1994 on with open orders fulfilled."""
    orders = table(spark, sf_dir, "orders").withColumn("price", F.round("o_totalprice", 2))
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "price"]
    before = orders.filter("o_orderdate < DATE'1998-01-01'").select(columns)
    status = F.when(F.col("o_orderstatus") == "O", "F").otherwise(F.col("o_orderstatus"))
    after = orders.filter("o_orderdate >= DATE'1994-01-01'").withColumn("o_orderstatus", status)
    return changes.change_rows(before, after.select(columns), ["o_orderkey"])


def content_key_sql(*columns: str) -> str:
    parts = ", ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in columns)
    return f"sha256(concat_ws(',', {parts}))"


@query(f"SELECT doc_id, {content_key_sql('source', 'lang', 'text')} AS id "
       "FROM (SELECT doc_id, source, text, nullif(lang, 'en') AS lang FROM documents)")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of rows of which many have a null."""
    documents = table(spark, sf_dir, "documents").withColumn("lang", F.nullif(F.col("lang"), F.lit("en")))
    return changes.with_content_key(documents, ["source", "lang", "text"]).select("doc_id", "id")


# --- nested data and functions ----------------------------------------------------------------

CALL_ROWS_SQL = "SELECT conv_id, CAST(conv_id AS VARCHAR) AS call_id, turn, role, text FROM conversations"


@query(
    f"""
    SELECT call_id AS "conversation.id", CAST(sum(length(text) * 100) AS BIGINT) AS "conversation.duration",
           'Conversation ' || CAST(conv_id AS VARCHAR) AS "extensiveConversation.data.title",
           count(*) AS n_sentences, 2 * count(DISTINCT role) FILTER (role <> 'system') AS n_attendees
    FROM ({CALL_ROWS_SQL}) GROUP BY call_id, conv_id
    """
)
def flatten_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call documents written as JSON text, read back with the declared schema, and flattened."""
    calls = derived.turns_as_calls(table(spark, sf_dir, "conversations"))
    texts = calls.select(F.to_json(F.struct("*")).alias("document"))
    flat = flatten(parse_calls(texts, F.col("document")))
    return flat.select(
        "`conversation.id`",
        "`conversation.duration`",
        "`extensiveConversation.data.title`",
        F.size("sentences").cast("long").alias("n_sentences"),
        F.size("`extensiveConversation.data.attendees`").cast("long").alias("n_attendees"),
    )


@query(
    f"""
    SELECT call_id AS conversation_id, turn AS order_number, text,
           {derived.SPEAKER_ID_SQL.replace("STRING", "VARCHAR")} AS recording_attendee_id,
           round(length(text) / 10.0, 6) AS seconds
    FROM ({CALL_ROWS_SQL})
    """
)
def read_call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call documents written to JSON files, one per line, and read back as sentence rows."""
    folder = work_folder(spark, "calls")
    derived.turns_as_calls(table(spark, sf_dir, "conversations")).write.json(folder)
    return sentence_rows(read_calls(spark, folder, one_per_file=False)).select(
        "conversation_id",
        "order_number",
        "recording_attendee_id",
        "text",
        F.round(F.col("end_time") - F.col("start_time"), 6).alias("seconds"),
    )


@query(
    """
    WITH packed AS (
        SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts
        FROM conversations GROUP BY 1)
    SELECT conv_id, array_to_string(roles, ',') AS roles,
           array_to_string(roles[1:len(roles) - 1], ',') AS roles_but_last,
           texts[1] AS first_text, texts[len(texts)] AS last_text,
           list_filter(list_zip(roles, texts), lambda x: x[1] = 'system')[1][2] AS first_system_text,
           CAST(len(list_filter(roles, lambda r: r = 'user')) AS BIGINT) AS n_user,
           CAST(list_sum(list_transform(texts, lambda t: length(t))) AS BIGINT) AS n_chars
    FROM packed
    """
)
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lambdas over arrays, guarded element access, slices and joins of array elements."""
    turns = table(spark, sf_dir, "conversations")
    message = F.struct("turn", "role", "text")
    packed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    roles = F.transform("m", lambda m: m["role"])
    system = F.filter("m", lambda m: m["role"] == "system")
    lengths = F.transform("m", lambda m: F.length(m["text"]))
    return packed.select(
        "conv_id",
        F.array_join(roles, ",").alias("roles"),
        F.array_join(all_but_last(roles), ",").alias("roles_but_last"),
        first_or_null(F.col("m"))["text"].alias("first_text"),
        last_or_null(F.col("m"))["text"].alias("last_text"),
        first_or_null(system)["text"].alias("first_system_text"),
        F.size(F.filter(roles, lambda r: r == "user")).cast("long").alias("n_user"),
        F.aggregate(lengths, F.lit(0), lambda a, n: a + n).cast("long").alias("n_chars"),
    )


@query(
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS packed
    FROM events
    """
)
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    packed = F.to_json(F.struct("event_type", F.col("p.k").alias("k")))
    return events.select("event_id", F.col("p.k").alias("k"), packed.alias("packed"))


@query(
    """
    SELECT doc_id, 'Passage: ' || text || chr(10) || 'from ' || source || ' {' || lang || '}' AS passage
    FROM documents
    """
)
def template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = fill_template(
        "Passage: {text}\nfrom {source} {{{lang}}}",
        text=F.col("text"),
        source=F.col("source"),
        lang=F.col("lang"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", filled.alias("passage"))


# --- transcripts ------------------------------------------------------------------------------


def _sql(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


LABELS_SQL = _sql(
    f"""
    SELECT conv_id, role, {derived.SPEAKER_ID_SQL} AS speaker_id,
           coalesce(nullif({derived.EMAIL_SQL}, ''), nullif({derived.NAME_SQL}, ''),
                    {derived.SECOND_NAME_SQL}) AS label
    FROM (SELECT DISTINCT conv_id, role FROM conversations WHERE {derived.HAS_ATTENDEE_SQL})
    """
)
LINES_SQL = _sql(
    f"""
    SELECT c.conv_id, c.turn, c.role, c.text,
           coalesce(l.label, CAST(c.conv_id AS VARCHAR) || '-' || c.role) AS speaker,
           coalesce(l.label, CAST(c.conv_id AS VARCHAR) || '-' || c.role) || ' : ' || c.text AS line
    FROM conversations c LEFT JOIN ({LABELS_SQL}) l ON l.conv_id = c.conv_id AND l.role = c.role
    """
)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return transcript.label_speakers_rows(
        derived.turns_as_sentences(turns), derived.roles_as_attendees(turns)
    )


@query(f"SELECT conv_id AS conversation_id, turn AS order_number, line FROM ({LINES_SQL})")
def label_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).drop("speaker")


@query(
    f"""
    SELECT CAST(conv_id AS VARCHAR) AS conversation_id,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, line
    FROM ({LINES_SQL})
    """
)
def label_speakers_in_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = derived.turns_as_calls(table(spark, sf_dir, "conversations"))
    labelled = transcript.label_speakers(flatten(calls))
    return labelled.select(
        F.col("`conversation.id`").alias("conversation_id"),
        F.posexplode("sentences_updated").alias("place", "line"),
    ).withColumn("place", F.col("place").cast("long"))


# A part holds so many lines, counted from the first one of the conversation.
TRANSCRIPTS_SQL = f"""
    SELECT conv_id AS conversation_id, place // 1024 AS part,
           CAST(to_json(list(line ORDER BY turn)) AS VARCHAR) AS transcript
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM ({LINES_SQL}))
    GROUP BY 1, 2
"""


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = transcript.transcript_parts(_lines(spark, sf_dir))
    joined = transcript.transcript_text(F.col("sentences_updated"))
    return parts.select("conversation_id", "part", joined.alias("transcript"))


@query(TRANSCRIPTS_SQL)
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPT_START, PROMPT_END = transcript.assessment_template(derived.MARKER).split("{transcript}")


@query(
    f"""
    SELECT conversation_id, part, {_quoted(PROMPT_START)} || transcript || {_quoted(PROMPT_END)} AS prompt
    FROM ({TRANSCRIPTS_SQL})
    """
)
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = transcript.build_prompt(
        F.col("transcript"), transcript.assessment_template(derived.MARKER)
    )
    return _transcripts(spark, sf_dir).select("conversation_id", "part", prompt.alias("prompt"))


@query(
    f"""
    SELECT DISTINCT conv_id AS conversation_id, speaker,
           CASE WHEN contains(lower(speaker), 'acme') THEN 'sales rep' ELSE 'customer' END AS role
    FROM ({LINES_SQL})
    """
)
def role_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    speakers = _lines(spark, sf_dir).select("conversation_id", "speaker").distinct()
    return speakers.withColumn("role", text.tag_role(F.col("speaker"), derived.MARKER))


MASK_SALT = "turnwise"


@query(
    r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
               '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'),
               '\+?[0-9][0-9 ()-]{6,}[0-9]', '[phone]', 'g'),
               '[0-9]{4,}', '[number]', 'g') AS text
    FROM documents
    """
)
def mask_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = text.mask_patterns(F.col("text"))
    documents = use_all_cores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select("doc_id", masked.alias("text"))


STAND_IN_SQL = f"'person-' || substr(sha256('{MASK_SALT}' || chr(1) || {{}}), 1, 24)"


@query(
    f"""
    WITH named AS (SELECT *, min(speaker) OVER (PARTITION BY conv_id) AS other FROM ({LINES_SQL}))
    SELECT conv_id AS conversation_id, turn AS order_number,
           {STAND_IN_SQL.format("speaker")} || ' : ' || regexp_replace(
               regexp_replace(regexp_replace(text,
               '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[email]', 'g'),
               '\\+?[0-9][0-9 ()-]{{6,}}[0-9]', '[phone]', 'g'),
               '[0-9]{{4,}}', '[number]', 'g') || ' ; ' || {STAND_IN_SQL.format("other")} AS line
    FROM named
    """
)
def mask_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that also name another person of the call; all names of a call are masked in all its lines.

    A call has as many names as attendees, so these are gathered per call; lines are not.
    """
    lines = stored(_lines(spark, sf_dir), "lines")
    names = lines.groupBy("conversation_id").agg(
        F.collect_set("speaker").alias("names"), F.min("speaker").alias("other")
    )
    joined = spread_join(lines, names, ["conversation_id"], [F.col("order_number")])
    masked = text.mask_pii(F.concat("line", F.lit(" ; "), "other"), F.col("names"), MASK_SALT)
    return joined.select("conversation_id", "order_number", masked.alias("line"))


@query(
    """
    SELECT conv_id AS conversation_id, CAST(conv_id AS VARCHAR) || '-' || role AS recording_attendee_id,
           count(*) AS n_sentences, CAST(sum(length(text)) * 100 AS BIGINT) AS talk_time,
           round(100.0 * sum(length(text)) / sum(sum(length(text))) OVER (PARTITION BY conv_id), 2)
               AS percent_talk_time
    FROM conversations GROUP BY conv_id, role
    """
)
def talk_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.talk_time(
        derived.turns_as_sentences(table(spark, sf_dir, "conversations"))
    )


OVERLAPS_SQL = """
    WITH said AS (
        SELECT conv_id AS conversation_id, CAST(conv_id AS VARCHAR) || '-' || role AS speaker,
               10 * turn AS start_time, 10 * turn + length(text) / 10.0 AS end_time FROM conversations),
    times AS (SELECT conversation_id, start_time AS t FROM said UNION SELECT conversation_id, end_time FROM said),
    spans AS (SELECT conversation_id, t AS a, lead(t) OVER (PARTITION BY conversation_id ORDER BY t) AS b FROM times),
    heard AS (
        SELECT p.conversation_id, a, b, speaker, count(*) OVER (PARTITION BY p.conversation_id, a) AS n
        FROM spans p JOIN said s ON s.conversation_id = p.conversation_id AND start_time <= a AND end_time >= b AND a < b
        GROUP BY p.conversation_id, a, b, speaker),
    sums AS (SELECT conversation_id, speaker, sum(end_time - start_time) AS spoken FROM said GROUP BY 1, 2)
    SELECT conversation_id, speaker AS recording_attendee_id, CAST(round(1000 * any_value(spoken)) AS BIGINT) AS talk_time,
           CAST(round(1000 * coalesce(sum(b - a), 0)) AS BIGINT) AS distinct_time,
           CAST(round(1000 * coalesce(sum(b - a) FILTER (n > 1), 0)) AS BIGINT) AS crosstalk
    FROM sums LEFT JOIN heard USING (conversation_id, speaker) GROUP BY conversation_id, speaker
"""


@query(OVERLAPS_SQL)
def talk_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talk time where turns begin ten seconds apart, so that many overlap."""
    turns = table(spark, sf_dir, "conversations")
    sentences = derived.turns_as_sentences(turns)
    length = F.col("end_time") - F.col("start_time")
    close = sentences.withColumn("end_time", F.col("start_time") / 10 + length).withColumn("start_time", F.col("start_time") / 10)
    return transcript.talk_overlaps(close, span=60.0)


MOMENTS_SQL = """
    SELECT conv_id AS conversation_id, text, role, turn,
           CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS item, turn % 2 AS category,
           turn AS index_start, turn + conv_id % 3 AS index_end
    FROM conversations
"""
# Conversations whose number ends in 7 have no block, in 8 a block without items, and assistants no mentions.
MOMENT_ROWS_SQL = f"""
    WITH kept AS (SELECT * FROM ({MOMENTS_SQL}) WHERE conversation_id % 10 < 7 OR conversation_id % 10 = 9),
    every AS (SELECT DISTINCT conv_id AS conversation_id FROM conversations),
    items AS (SELECT conversation_id, role, row_number() OVER (PARTITION BY conversation_id ORDER BY role) - 1 AS item_at
              FROM (SELECT DISTINCT conversation_id, role FROM kept)),
    categories AS (SELECT conversation_id, role, category, row_number() OVER (PARTITION BY conversation_id, role ORDER BY category) - 1 AS category_at
                   FROM (SELECT DISTINCT conversation_id, role, category FROM kept)),
    mentions AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, role, category ORDER BY turn) - 1 AS mention_at
                 FROM kept WHERE role <> 'assistant')
    SELECT e.conversation_id, i.item_at, i.role AS item, c.category_at, CAST(c.category AS VARCHAR) AS category,
           m.mention_at, m.index_start, m.index_end
    FROM every e LEFT JOIN items i USING (conversation_id) LEFT JOIN categories c USING (conversation_id, role)
    LEFT JOIN mentions m USING (conversation_id, role, category)
"""


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.moment_rows(derived.turns_as_moments(table(spark, sf_dir, "conversations")))


@query(MOMENT_ROWS_SQL)
def key_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mention with its path; an item, category or block without any is a row as well."""
    return _moments(spark, sf_dir).select(
        F.col("conversation_id").cast("long").alias("conversation_id"),
        "item_at",
        "item",
        "category_at",
        "category",
        "mention_at",
        "index_start",
        "index_end",
    )


@query(
    f"""
    SELECT m.conversation_id, m.item_at, m.category_at, m.mention_at, s.turn AS order_number, s.text
    FROM ({MOMENT_ROWS_SQL}) m JOIN conversations s ON s.conv_id = m.conversation_id
         AND s.turn BETWEEN m.index_start AND m.index_end
    """
)
def mentioned_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that each mention spans."""
    sentences = derived.turns_as_sentences(table(spark, sf_dir, "conversations"))
    mentions = _moments(spark, sf_dir).withColumn("conversation_id", F.col("conversation_id").cast("long"))
    return transcript.mentioned_sentences(mentions, sentences, width=2).select(
        "conversation_id", "item_at", "category_at", "mention_at", "order_number", "text"
    )


@query(
    """
    SELECT o.conv_id AS conversation_id, i.turn, i.item_at, i.text
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN
         (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS item_at, text
          FROM conversations WHERE role = 'assistant' AND conv_id % 10 <> 7) i USING (conv_id)
    """
)
def action_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per action item, and one for a call without any."""
    rows = transcript.action_item_rows(derived.turns_as_moments(table(spark, sf_dir, "conversations")))
    return rows.select(
        F.col("conversation_id").cast("long").alias("conversation_id"),
        F.col("id").cast("long").alias("turn"),
        "item_at",
        F.col("original_text").alias("text"),
    )


# --- assessments ------------------------------------------------------------------------------

# The answer of an imaginary model, as text, from the turns of each role. Every ninth conversation
# in turn gets one of eight kinds of damage; the rest are whole. Valid in Spark and in the checking engine.
FILLED_LISTS = {"communication", "strengths"}


def _participant_sql(key: str) -> str:
    if key == "performance_score":
        value = (
            "CASE WHEN conv_id % 9 = 3 THEN '\"' || CAST(n_turns AS STRING) || '\"' "
            "WHEN conv_id % 9 = 8 THEN CAST(n_turns AS STRING) || '.5' ELSE CAST(n_turns AS STRING) END"
        )
    elif key in PARTICIPANT_TEXT_LISTS:
        items = "'[\"turns: ' || CAST(n_turns AS STRING) || '\"]'" if key in FILLED_LISTS else "'[]'"
        value = items
    elif key == "meeting_summary_from_my_perspective":
        value = "said"
    elif key == "name":
        value = "'\"' || speaker || '\"'"
    else:
        value = "'\"' || role || '\"'"
    pair = f"'\"{key}\":' || {value}"
    if key == "email_id":
        return f"CASE WHEN conv_id % 9 = 4 THEN '\"extra\":1' ELSE {pair} END"
    return pair


def _parsed_sql(key: str) -> str:
    missing = {"performance_score": "(3, 8)", "email_id": "(4)"}.get(key)
    if missing is None:
        return _participant_sql(key)
    return f"CASE WHEN conv_id % 9 NOT IN {missing} THEN {_participant_sql(key)} END"


PARTICIPANT_SQL = (
    "'{' || " + " || ',' || ".join(_participant_sql(k) for k in PARTICIPANT_KEYS) + " || '}'"
)
RESPONSE_SQL = """
    CASE conv_id % 9 WHEN 0 THEN 'I cannot answer' WHEN 1 THEN '' WHEN 2 THEN '[' || participants || ']'
         WHEN 5 THEN '{"participants":{}}' WHEN 6 THEN '{"participants":[]}'
         ELSE '{"participants":[' || participants || ']}' END
"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    spoken = F.sort_array(F.collect_list(F.struct("turn", "text")))
    said = F.array_join(F.transform(spoken, lambda t: t["text"]), " ")
    quoted_text = F.regexp_extract(F.to_json(F.array("said")), r"(?s)^\[(.*)\]$", 1)
    people = (
        turns.groupBy("conv_id", "role")
        .agg(F.count(F.lit(1)).alias("n_turns"), said.alias("said"))
        .withColumn("said", quoted_text)
        .withColumn("speaker", F.expr(derived.SPEAKER_ID_SQL))
    )
    # One entry per role: the given data has three. An answer is one value with all that they said.
    listed = people.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("role", F.expr(PARTICIPANT_SQL).alias("p")))).alias("all")
    )
    joined = F.array_join(F.transform("all", lambda x: x["p"]), ",")
    return listed.select("conv_id", joined.alias("participants")).select(
        F.col("conv_id").alias("conversation_id"), F.expr(RESPONSE_SQL).alias("response")
    )


PEOPLE_SQL = f"""
    SELECT conv_id, role, count(*) AS n_turns, {derived.SPEAKER_ID_SQL} AS speaker,
           CAST(to_json(string_agg(text, ' ' ORDER BY turn)) AS VARCHAR) AS said
    FROM conversations GROUP BY conv_id, role
"""
RESPONSES_SQL = _sql(
    f"""
    SELECT conv_id AS conversation_id, {RESPONSE_SQL} AS response
    FROM (SELECT conv_id, string_agg({PARTICIPANT_SQL}, ',' ORDER BY role) AS participants
          FROM ({PEOPLE_SQL}) GROUP BY conv_id)
    """
)
# In the checking engine a score that is not a whole number has no value.
PARSED_SQL = f"""
    SELECT conversation_id, json_extract(response, '$.participants') AS participants
    FROM ({RESPONSES_SQL})
    WHERE response LIKE '{{"participants":[%'
"""


@query(
    f"""
    SELECT r.conversation_id, CASE WHEN response = '' THEN NULL
               WHEN len(p.found) IS NULL THEN NULL ELSE CAST(len(p.found) AS BIGINT) END AS n_participants
    FROM ({RESPONSES_SQL}) r LEFT JOIN
         (SELECT conversation_id, CAST(participants AS JSON[]) AS found FROM ({PARSED_SQL})) p
         ON p.conversation_id = r.conversation_id
    """
)
def assess_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = assess.parse_assessment(_responses(spark, sf_dir))
    found = F.col("participant_analysis.participants")
    n = F.when(found.isNotNull(), F.size(found)).cast("long")
    return parsed.select("conversation_id", n.alias("n_participants"))


EXPLODED_SQL = f"""
    SELECT conversation_id, json_extract_string(p, '$.name') AS name,
           json_extract_string(p, '$.role') AS role, json_extract_string(p, '$.email_id') AS email_id,
           CASE WHEN json_type(p, '$.performance_score') = 'UBIGINT'
                THEN CAST(json_extract_string(p, '$.performance_score') AS BIGINT) END AS performance_score,
           json_extract_string(p, '$.communication[0]') AS first_communication,
           json_extract_string(p, '$.meeting_summary_from_my_perspective') AS summary
    FROM (SELECT conversation_id, unnest(CAST(participants AS JSON[])) AS p FROM ({PARSED_SQL}))
"""


def _exploded(spark: SparkSession, sf_dir: str, outer: bool) -> DataFrame:
    parsed = assess.parse_assessment(_responses(spark, sf_dir))
    return assess.explode_participants(parsed, ["conversation_id"], outer).select(
        "conversation_id",
        "name",
        "participant.role",
        "participant.email_id",
        "participant.performance_score",
        F.get("participant.communication", F.lit(0)).alias("first_communication"),
        F.col("participant.meeting_summary_from_my_perspective").alias("summary"),
    )


@query(EXPLODED_SQL)
def explode_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, outer=False)


@query(
    f"""
    SELECT r.conversation_id, e.name, e.role, e.email_id, e.performance_score, e.first_communication, e.summary
    FROM ({RESPONSES_SQL}) r LEFT JOIN ({EXPLODED_SQL}) e ON e.conversation_id = r.conversation_id
    """
)
def explode_participants_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(spark, sf_dir, outer=True)


# The same participant without the values that have no place in the declared schema.
PARSED_PARTICIPANT_SQL = (
    "'{' || array_to_string(list_filter(["
    + ", ".join(_parsed_sql(k) for k in PARTICIPANT_KEYS)
    + "], lambda x: x IS NOT NULL), ',') || '}'"
)


@query(
    _sql(
        f"""
        SELECT conv_id AS conversation_id, speaker AS name, {PARSED_PARTICIPANT_SQL} AS content
        FROM ({PEOPLE_SQL}) WHERE conv_id % 9 IN (3, 4, 7, 8)
        """
    )
)
def participant_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text to embed of every participant: its parsed struct as JSON."""
    parsed = assess.parse_assessment(_responses(spark, sf_dir))
    return contents_of(assess.explode_participants(parsed, ["conversation_id"]))


@query(
    f"""
    SELECT conversation_id, CASE
        WHEN NOT json_valid(response) OR json_type(response) <> 'OBJECT' THEN 'not a JSON object'
        WHEN json_type(response, '$.participants') <> 'ARRAY' THEN 'participants is not an array'
        WHEN response LIKE '%"extra":%' THEN 'missing email_id,unexpected extra'
        WHEN json_type(response, '$.participants[0].performance_score') <> 'UBIGINT'
             THEN 'wrong type performance_score'
        ELSE '' END AS problems
    FROM ({RESPONSES_SQL})
    """
)
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = assess.validate_assessment(_responses(spark, sf_dir))
    return bad.select(
        "conversation_id", F.array_join("problems", ",").alias("problems")
    ).unionByName(good.select("conversation_id", F.lit("").alias("problems")))


@query(
    f"""
    WITH lines AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n_lines FROM ({LINES_SQL})),
    prompts AS (
        SELECT conversation_id, md5({_quoted(PROMPT_START)} || transcript || {_quoted(PROMPT_END)}) AS digest
        FROM ({TRANSCRIPTS_SQL}))
    SELECT conv_id AS conversation_id, speaker AS name,
           CASE WHEN contains(lower(speaker), 'acme') THEN 'sales rep' ELSE 'customer' END AS role,
           1 + 9 * count(*) // max(n_lines) AS performance_score,
           CASE WHEN 2 * count(*) >= max(n_lines) THEN 'high' ELSE 'low' END AS engagement_level,
           arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text, any_value(digest) AS digest
    FROM lines JOIN prompts ON conversation_id = conv_id GROUP BY conv_id, speaker
    """
)
def assess_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model run over all prompts, its answers checked, and one row per conversation and participant."""
    model = ExtractiveAssessor(
        derived.MARKER, transcript.TRANSCRIPT_MARK, transcript.TRANSCRIPT_END
    )
    prompts = stored(prompt_build(spark, sf_dir), "prompts")
    good, _ = assess.assess_prompts(prompts, model, work_folder(spark, "answers"))
    exploded = assess.explode_participants(good, ["conversation_id", "part"])
    return assess.merge_parts(exploded, ["conversation_id"], model).select(
        "conversation_id",
        "name",
        "participant.role",
        "participant.performance_score",
        "participant.engagement_level",
        F.col("participant.meeting_summary_from_my_perspective").alias("first_text"),
        F.col("participant.meeting_summary_from_their_perspective").alias("last_text"),
        F.col("participant.sales_impact").alias("digest"),
    )


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assessments: a user is a participant, a day is a meeting, the value is the score."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"),
        F.to_date("ts").alias("conversation_id"),
        "value",
    )


@query(
    """
    SELECT 'user-' || CAST(user_id AS VARCHAR) AS name, count(DISTINCT CAST(ts AS DATE)) AS n_meetings
    FROM events GROUP BY user_id
    """
)
def participant_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.meetings_per_participant(_scores(spark, sf_dir))


@query(
    """
    SELECT 'user-' || CAST(user_id AS VARCHAR) AS name, count(value) AS n_scores,
           round(avg(value), 4) AS avg_score, round(stddev_samp(value), 4) AS stddev_score,
           min(value) AS min_score, max(value) AS max_score
    FROM events GROUP BY user_id
    """
)
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = assess.consistency(_scores(spark, sf_dir), F.col("value"))
    for column in ("avg_score", "stddev_score"):
        report = report.withColumn(column, F.round(column, 4))
    return report


# --- vectors, index, search -------------------------------------------------------------------


@query(f"SELECT id AS doc_id, bucket, round(v, 6) AS weight FROM ({hashed_vectors('documents', 'doc_id')})")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = use_all_cores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    vectors = documents.select("doc_id", embed(F.col("text"), EMBEDDER).alias(EMBEDDING))
    return _nonzero_weights(vectors, "doc_id")


@query(
    """
    SELECT vec_id, len(embedding) = 64 AS fits,
           round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm
    FROM embeddings
    """
)
def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = check_dimension(table(spark, sf_dir, "embeddings"), DIM)
    both = good.withColumn("fits", F.lit(True)).unionByName(bad.withColumn("fits", F.lit(False)))
    return both.select("vec_id", "fits", F.round(vector_norm(F.col(EMBEDDING)), 6).alias("norm"))


@query(
    r"""
    SELECT term, doc_id AS pk, count(*) AS tf, any_value(dl) AS dl
    FROM (SELECT doc_id, unnest(t) AS term, len(t) AS dl
          FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents))
    GROUP BY 1, 2
    """
)
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = use_all_cores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = term_counts(documents, "doc_id", "text")
    return counts.withColumn("tf", F.col("tf").cast("long")).withColumn("dl", F.col("dl").cast("long"))


SYNCED_SQL = """
    SELECT doc_id, source, CASE WHEN lang = 'en' THEN text || ' ' || source ELSE text END AS text
    FROM documents WHERE lang <> 'de'
"""


@query(
    f"""
    WITH state AS ({SYNCED_SQL}), vec AS ({hashed_vectors("state", "doc_id")})
    SELECT doc_id AS pk, source, length(text) AS n_chars,
           CAST(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS BIGINT) AS dl,
           coalesce(p.n_postings, 0) AS n_postings, round(coalesce(p.sum_v, 0), 4) AS sum_v
    FROM state LEFT JOIN (
        SELECT id, round(sum(v), 4) AS sum_v, any_value(n) AS n_postings
        FROM vec JOIN (SELECT doc_id AS id, count(DISTINCT term) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM state)
            GROUP BY 1) USING (id) GROUP BY id) p ON p.id = state.doc_id
    """
)
def index_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all but the French documents, brought to a state without the German ones, with the
    French ones added and the English ones made longer."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    folder = work_folder(spark, "index")
    longer = F.concat("text", F.lit(" "), "source")
    rewritten = F.when(F.col("lang") == "en", longer).otherwise(F.col("text"))
    before = documents.filter("lang <> 'fr'")
    after = documents.filter("lang <> 'de'").withColumn("text", rewritten)
    for state in (before, after, after):
        create_or_sync(state.drop("lang"), folder, "doc_id", "text", DIM, model=EMBEDDER)
    index = open_index(spark, folder)
    counted = posting_rows(index).groupBy(PK).agg(F.count(F.lit(1)).alias("n_postings"), F.first("dl").alias("dl"))
    total = F.aggregate(EMBEDDING, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return index.docs.join(counted, PK, "left").select(
        PK,
        "source",
        F.length("content").cast("long").alias("n_chars"),
        F.coalesce("dl", F.lit(0)).cast("long").alias("dl"),
        F.coalesce("n_postings", F.lit(0)).alias("n_postings"),
        F.round(total, 4).alias("sum_v"),
    )


INDEX_FOLDERS: dict[tuple[str, str], str] = {}


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the documents, made once per application and folder of data, as long as it is there."""
    key = spark.sparkContext.applicationId, sf_dir
    folder = INDEX_FOLDERS.setdefault(key, work_folder(spark, "index"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    if not path_exists(spark, folder):
        build_index(documents, folder, "doc_id", "text", DIM, model=EMBEDDER, buckets=8)
    return open_index(spark, folder)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_hits_sql(doc_vectors: str, query_vectors: str, k: int) -> str:
    """Ranking of all pairs, from (id, bucket, v) rows on both sides."""
    return f"""
    SELECT query_id, pk, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) AS rank FROM (
            SELECT q.id AS query_id, d.id AS pk,
                   round(coalesce(sum(d.v * b.v), 0) / (d_norm * q_norm), 6) AS score
            FROM (SELECT id, sqrt(sum(v * v)) AS q_norm FROM ({query_vectors}) GROUP BY id) q
            CROSS JOIN (SELECT id, sqrt(sum(v * v)) AS d_norm FROM ({doc_vectors}) GROUP BY id) n
            JOIN ({doc_vectors}) d ON d.id = n.id
            LEFT JOIN ({query_vectors}) b ON b.id = q.id AND b.bucket = d.bucket
            GROUP BY q.id, d.id, d_norm, q_norm))
    WHERE rank <= {k}
    """


def keyword_hits_sql(docs: str, doc_id: str, asked: str, query_id: str, k: int) -> str:
    return f"""
    SELECT query_id, pk, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) AS rank FROM (
            SELECT query_id, pk, round(sum(
                ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))
                ), 6) AS score
            FROM (SELECT DISTINCT {query_id} AS query_id,
                         unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {asked})
            JOIN (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (
                      SELECT pk, term, any_value(dl) AS dl, count(*) AS tf FROM (
                          SELECT {doc_id} AS pk, unnest(t) AS term, len(t) AS dl FROM (
                              SELECT {doc_id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t
                              FROM {docs}))
                      GROUP BY 1, 2)) USING (term)
            CROSS JOIN (SELECT count(*) AS n,
                               avg(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS avg_dl FROM {docs})
            GROUP BY 1, 2))
    WHERE rank <= {k}
    """


def hybrid_hits_sql(docs: str, doc_id: str, asked: str, query_id: str, k: int) -> str:
    vector = vector_hits_sql(hashed_vectors(docs, doc_id), hashed_vectors(asked, query_id), 50)
    keyword = keyword_hits_sql(docs, doc_id, asked, query_id, 50)
    return f"""
    SELECT query_id, pk, score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pk) AS rank FROM (
            SELECT query_id, pk, round(sum(1.0 / (60 + rank)), 6) AS score
            FROM (SELECT query_id, pk, rank FROM ({vector}) UNION ALL
                  SELECT query_id, pk, rank FROM ({keyword}))
            GROUP BY 1, 2))
    WHERE rank <= {k}
    """


KNN_SQL = vector_hits_sql(
    "SELECT vec_id AS id, unnest(range(len(embedding))) AS bucket, unnest(embedding)::DOUBLE AS v FROM embeddings",
    hashed_vectors("benchmark", "item_id"),
    K,
)


@query(KNN_SQL)
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors nearest to each benchmark text's vector."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(PK), EMBEDDING, vector_norm(F.col(EMBEDDING)).alias("norm")
    )
    asked = search.embed_queries(_questions(spark, sf_dir), EMBEDDER)
    return search.search_vector(asked, Index(rows), K)


EMBEDDING_VECTORS_SQL = """
    SELECT vec_id AS id, unnest(range(len(embedding))) AS bucket, unnest(embedding)::DOUBLE AS v FROM embeddings
"""
FIFTIETH_SQL = f"SELECT * FROM ({EMBEDDING_VECTORS_SQL}) WHERE id % 50 = 0"


def _embedding_index(spark: SparkSession, sf_dir: str) -> tuple[Index, DataFrame]:
    """A stored index of the given vectors, and every fiftieth of them as a query."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    index = build_index(rows, work_folder(spark, "vector-index"), "vec_id", "label", DIM, vector=EMBEDDING, buckets=2)
    return index, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), EMBEDDING)


@query(vector_hits_sql(EMBEDDING_VECTORS_SQL, FIFTIETH_SQL, K))
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all given vectors to every fiftieth, exactly, from the cells of a stored index."""
    index, asked = _embedding_index(spark, sf_dir)
    return search.search_vector(asked, index, K)


@query(
    f"""
    SELECT count(*) AS n_queries, count(*) * least({K}, any_value(n)) AS n_true, true AS nine_in_ten
    FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 50 = 0
    """
)
def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the nearest cells alone find nine of ten of the true neighbours of every fiftieth vector.

    How many cells that takes is learnt from other vectors, 64 at most.
    """
    index, asked = _embedding_index(spark, sf_dir)
    others = index.docs.filter("pk % 50 = 7").select(F.col(PK).alias("query_id"), EMBEDDING).orderBy("query_id").limit(64)
    probes = search.probes_for_recall(others, index, K)
    exact = search.search_vector(asked, index, K).select("query_id", PK)
    near = search.search_vector(asked, index, K, probes=probes, exact=False)
    near = near.select("query_id", PK, F.lit(1).alias("is_found"))
    return exact.join(near, ["query_id", PK], "left").agg(
        F.count_distinct("query_id").alias("n_queries"),
        F.count(F.lit(1)).alias("n_true"),
        (F.count("is_found") >= 0.9 * F.count(F.lit(1))).alias("nine_in_ten"),
    )


@query(keyword_hits_sql("documents", "doc_id", "benchmark", "item_id", K))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = keyword_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    return search.search_keyword(_questions(spark, sf_dir), documents, K)


HYBRID_SQL = hybrid_hits_sql("documents", "doc_id", "benchmark", "item_id", K)


@query(
    f"""
    SELECT query_id, pk, rank, score, source FROM ({HYBRID_SQL}) JOIN documents ON doc_id = pk
    """
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = document_index(spark, sf_dir)
    asked = search.embed_queries(_questions(spark, sf_dir), EMBEDDER)
    return search.with_columns(search.search_hybrid(asked, index, K), index, ["source"])


# --- chats ------------------------------------------------------------------------------------

@query(
    """
    SELECT conv_id, turn, role, text FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)
    WHERE age <= 3
    """
)
def newest_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.newest_turns(table(spark, sf_dir, "conversations"), 3)


@query(
    """
    SELECT conv_id, turn, role, text, n_left_out FROM (
        SELECT *, count(*) FILTER (used > 300) OVER (PARTITION BY conv_id) AS n_left_out FROM (
            SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations))
    WHERE used <= 300
    """
)
def turns_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest messages of at most 300 characters together, and how many older ones were left out."""
    return chat.turns_within(table(spark, sf_dir, "conversations"), 300).select("conv_id", "turn", "role", "text", "n_left_out")


LAST_SQL = """
    SELECT conv_id, arg_max(text, turn) AS question, max(turn) AS last_turn, count(*) AS n_turns
    FROM conversations GROUP BY conv_id
"""


@query(LAST_SQL)
def last_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.last_questions(table(spark, sf_dir, "conversations"))


HISTORY_SQL = """
    SELECT conv_id, turn, role, text FROM
        (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations)
    WHERE turn < last_turn
"""


@query(HISTORY_SQL)
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_history(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "text"
    )


@query(
    f"""
    SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS speaker
    FROM ({HISTORY_SQL}) WHERE role IN ('user', 'assistant')
    """
)
def formatted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_history(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "role", "text", "speaker"
    )


@query("SELECT conv_id, count(*) > 1 AS needs_rewrite FROM conversations GROUP BY conv_id")
def rewrite_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rewrite_needed(table(spark, sf_dir, "conversations"))


REWRITE_PIECES = chat.REWRITE_TEMPLATE.replace("{question}", "{chat_history}").split("{chat_history}")


@query(
    f"""
    SELECT conv_id, {_quoted(REWRITE_PIECES[0])} || CAST(to_json(list({{'role': role, 'content': text}} ORDER BY turn))
               AS VARCHAR) || {_quoted(REWRITE_PIECES[1])} || any_value(question) || {_quoted(REWRITE_PIECES[2])}
           AS prompt
    FROM ({HISTORY_SQL}) JOIN (SELECT conv_id, question FROM ({LAST_SQL})) USING (conv_id)
    GROUP BY conv_id
    """
)
def rewrite_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rewrite_prompts(table(spark, sf_dir, "conversations"))


@query(
    """
    SELECT conv_id, turn, role, text, count(*) AS copies,
           CASE WHEN conv_id IS NULL THEN 'no conversation' WHEN turn IS NULL THEN 'no turn'
                WHEN role IS NULL THEN 'no role' WHEN text IS NULL THEN 'no text'
                WHEN sum(count(*)) OVER (PARTITION BY conv_id, turn) > 1 THEN 'turn is not unique'
                ELSE 'good' END AS problem
    FROM (SELECT conv_id, turn, nullif(role, 'system') AS role, text FROM conversations
          UNION ALL SELECT conv_id, 0, role, text FROM conversations WHERE role = 'assistant'
          UNION ALL SELECT nullif(conv_id, conv_id), turn, 'user', 'x' FROM conversations WHERE role = 'user'
          UNION ALL SELECT conv_id, NULL, role, text FROM conversations WHERE role = 'user')
    GROUP BY conv_id, turn, role, text
    """
)
def message_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given messages with damage: no role for system messages, answers repeated as turn 0, and
    user messages repeated without a conversation and without a turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = turns.withColumn("role", F.nullif(F.col("role"), F.lit("system"))).unionByName(
        turns.filter("role = 'assistant'").withColumn("turn", F.lit(0).cast("long"))
    )
    users = turns.filter("role = 'user'")
    lost = users.withColumn("conv_id", F.lit(None).cast("long")).withColumn("text", F.lit("x"))
    damaged = damaged.unionByName(lost).unionByName(users.withColumn("turn", F.lit(None).cast("long")))
    good, bad = chat.check_messages(damaged)
    good = good.withColumn("copies", F.lit(1).cast("long")).withColumn("problem", F.lit("good"))
    return bad.unionByName(good)


CHAT_HITS_SQL = hybrid_hits_sql(
    "documents", "doc_id", f"(SELECT conv_id, question AS text FROM ({LAST_SQL}))", "conv_id", K
)
CONTEXTS_SQL = f"""
    SELECT query_id AS conv_id, string_agg('Passage: ' || text || chr(10), '' ORDER BY rank) AS context,
           string_agg(CAST(pk AS VARCHAR), ',' ORDER BY rank) AS source_keys
    FROM ({CHAT_HITS_SQL}) JOIN documents ON doc_id = pk GROUP BY query_id
"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    index = document_index(spark, sf_dir)
    hits = chat.retrieve(chat.search_queries(turns, None), index, EMBEDDER, K)
    return chat.contexts(hits, index, chat.RetrieverColumns(document_uri="source", name="lang"))


@query(CONTEXTS_SQL)
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages for every conversation's last question."""
    keys = F.array_join(F.transform("sources", lambda s: s["pk"].cast("string")), ",")
    return _contexts(spark, sf_dir).select("conv_id", "context", keys.alias("source_keys"))


ANSWER_PIECES = chat.ANSWER_TEMPLATE.replace("{question}", "{context}").split("{context}")


PROMPT_MESSAGES_SQL = f"""
    WITH last AS ({LAST_SQL}), found AS ({CONTEXTS_SQL})
    SELECT conv_id, -1 AS turn, 'system' AS role,
           {_quoted(ANSWER_PIECES[0])} || coalesce(context, '') || {_quoted(ANSWER_PIECES[1])} || question
               || {_quoted(ANSWER_PIECES[2])} AS content
    FROM last LEFT JOIN found USING (conv_id)
    UNION ALL SELECT conv_id, last_turn, 'user', question FROM last
    UNION ALL SELECT conv_id, turn, role, text FROM ({HISTORY_SQL}) WHERE role IN ('user', 'assistant')
"""


@query(PROMPT_MESSAGES_SQL)
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prompt_rows(table(spark, sf_dir, "conversations"), _contexts(spark, sf_dir))




@query(
    f"""
    SELECT conv_id, count(*) AS n_messages, CAST(sum(length(content)) AS BIGINT) AS prompt_chars
    FROM ({PROMPT_MESSAGES_SQL}) GROUP BY conv_id
    """
)
def prompt_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each finished prompt is; nothing is cut to fit a model."""
    prompts = chat.prompt_rows(table(spark, sf_dir, "conversations"), _contexts(spark, sf_dir))
    return chat.prompt_sizes(prompts).drop("prompt_key")


@query(
    f"""
    SELECT query_id AS conv_id, rank, pk, source AS uri, lang AS name
    FROM ({CHAT_HITS_SQL}) JOIN documents ON doc_id = pk
    """
)
def rag_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages behind each context, with the columns that the mapping names."""
    sources = _contexts(spark, sf_dir).select("conv_id", F.explode("sources").alias("s"))
    return sources.select("conv_id", F.col("s.rank").cast("long").alias("rank"), "s.pk", "s.uri", "s.name")


@query(
    f"""
    SELECT conv_id, md5(string_agg(role || ':' || content || chr(10), '' ORDER BY turn)) AS answer,
           CAST(NULL AS VARCHAR) AS error, any_value(source_keys) AS source_keys
    FROM ({PROMPT_MESSAGES_SQL}) LEFT JOIN ({CONTEXTS_SQL}) USING (conv_id) GROUP BY conv_id
    """
)
def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrite, retrieval, prompt and answer for every conversation.

    The stand-in gives the question back where a rewrite is asked for, and a digest of all messages
    where an answer is.
    """
    answers = chat.answer_chats(
        table(spark, sf_dir, "conversations"),
        document_index(spark, sf_dir),
        EMBEDDER,
        RewriteOrDigest(LastMessageModel(), DigestModel()),
        K,
        columns=chat.RetrieverColumns(document_uri="source", name="lang"),
    )
    sources = F.array_join(F.transform("sources", lambda s: s["pk"].cast("string")), ",")
    return answers.select("conv_id", "answer", "error", sources.alias("source_keys"))


# --- the rest of sources, sinks and functions -------------------------------------------------


@query(
    f"""
    SELECT call_id AS conversation_id, turn AS order_number, text FROM ({CALL_ROWS_SQL})
    """
)
def read_pretty_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pretty-printed document per file, in a folder that also holds files that are not JSON."""
    folder = work_folder(spark, "pretty-calls")
    calls = derived.turns_as_calls(table(spark, sf_dir, "conversations"))
    # Making a file costs more than its bytes: files are dealt out by number, and each task puts its own in place,
    # which otherwise the driver does, one after another.
    dealt = use_all_cores(calls, 4 * spark.sparkContext.defaultParallelism)
    one_each = dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    one_each.option("pretty", True).json(folder)
    calls.select(F.to_json("sentences").alias("note")).write.mode("append").text(folder)
    return sentence_rows(read_calls(spark, folder)).select("conversation_id", "order_number", "text")


@query(
    """
    SELECT conv_id, sum(length(text)) / 10.0 AS seconds, count(*) AS n_sentences,
           CASE WHEN conv_id % 10 = 3 THEN 'only here ' || conv_id END AS note
    FROM conversations GROUP BY conv_id
    """
)
def inferred_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose schema is found by reading them; a field that few have comes out as a column."""
    folder = work_folder(spark, "unknown-calls")
    turns = table(spark, sf_dir, "conversations")
    calls = turns.groupBy("conv_id").agg((F.sum(F.length("text")) / 10.0).alias("seconds"), F.count(F.lit(1)).alias("n_sentences"))
    note = F.when(F.col("conv_id") % 10 == 3, F.struct(F.concat(F.lit("only here "), "conv_id").alias("note")))
    calls.select("conv_id", F.struct("seconds", "n_sentences").alias("size"), note.alias("extra")).write.json(folder)
    flat = flatten(read_inferred(spark, folder, one_per_file=False))
    return flat.select("conv_id", F.col("`size.seconds`").alias("seconds"), F.col("`size.n_sentences`").alias("n_sentences"), F.col("`extra.note`").alias("note"))


@query("SELECT event_id, event_type FROM events")
def created_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table created where it is absent; creating it again leaves its rows."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    name = "turnwise_" + work_folder(spark, "created").rsplit("-", 1)[1]
    create_table(spark, name, events.schema)
    events.write.insertInto(name)
    create_table(spark, name, events.schema)
    return scan(spark, name)


@query("SELECT label_id, quality FROM (SELECT doc_id AS label_id, quality FROM labels)")
def configured_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in the place that the settings name."""
    names = Names(database="turnwise_" + work_folder(spark, "names").rsplit("-", 1)[1])
    before = spark.catalog.currentDatabase()
    use_database(spark, names)
    spark.catalog.setCurrentDatabase(before)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "quality")
    replace_table(labels, names.table("labelled_calls"))
    return scan(spark, names.table("labelled_calls"))


@query(
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'STRUCT<k: BIGINT>' AS found_schema
    FROM events
    """
)
def json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of a sample, and the column parsed by it."""
    found = json_schema_of('{"k": 1}')
    events = table(spark, sf_dir, "events")
    parsed = events.select("event_id", F.from_json("props", found).alias("p"), found.alias("found_schema"))
    return parsed.select("event_id", "p.k", "found_schema")


@query("SELECT item_id AS query_id, 0::BIGINT AS n_hits, '' AS context FROM benchmark")
def empty_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of words that no document has: no hits, and an empty context."""
    documents = keyword_index(table(spark, sf_dir, "documents"), "doc_id", "text")
    asked = _questions(spark, sf_dir)
    unknown = asked.withColumn("text", F.concat(F.lit("unheardofword"), F.sha2("text", 256)))
    hits = search.search_keyword(unknown, documents, K)
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    texts = chat.contexts(hits, documents).select(F.col("conv_id").alias("query_id"), "context")
    return asked.join(counted, "query_id", "left").join(texts, "query_id", "left").select(
        "query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("context", F.lit("")).alias("context")
    )


@query(
    _sql(
        f"""
        SELECT conv_id AS conversation_id, {derived.SPEAKER_ID_SQL} AS recording_attendee_id,
               CAST(sum(length(text)) * 100 AS BIGINT) AS talk_time,
               CASE WHEN role <> 'system' THEN CAST(count(*) * 1000 AS BIGINT) END AS stored_talk_time
        FROM conversations GROUP BY conv_id, role
        """
    )
)
def talk_beside_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talk time from the sentences beside what the attendee entries say, here a second per turn."""
    turns = table(spark, sf_dir, "conversations")
    said = turns.groupBy("conv_id", "role").agg((F.count(F.lit(1)) * 1000).alias("stored_talk_time"))
    claims = said.select(
        F.col("conv_id").alias("conversation_id"),
        F.expr(derived.SPEAKER_ID_SQL).alias("attendee_id"),
        "stored_talk_time",
        F.lit(None).cast("double").alias("stored_percent"),
    )
    attendees = derived.roles_as_attendees(turns).join(claims, ["conversation_id", "attendee_id"])
    return transcript.talk_time_beside_stored(derived.turns_as_sentences(turns), attendees).select(
        "conversation_id", "recording_attendee_id", "talk_time", "stored_talk_time"
    )
