"""Queries over inline inputs: what the tables at hand have no column for.

Each has a golden result, as SQL that lists it; the inputs are small on purpose
and every row counts. Credential-like strings are put together here, so that none
is written down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redact, text
from ..sources.durable import fresh_path
from ..sources.peek import peek_files
from ..sources.transcripts import usage_by_model, usage_records, weekly_usage
from . import repository
from .catalogue import cents, duck_scrub, query, table

COMMANDS = (
    "cd /srv && docker compose up -d; FOO=1 BAR=2 pytest tests/payment -x | tail -5",
    "git add . && git add x && git commit -m 'x' || echo no",
    "/usr/bin/python3 -m http.server; ls -la | sort | uniq -c",
    "docker --context prod compose up",
    "A=1",
    "",
    "make && make && terraform plan -out=x",
)


@query("""SELECT * FROM (VALUES (0, ['docker compose', 'pytest']), (1, ['git add', 'git commit']), (2, ['python3 http.server']), (3, ['docker prod']), (4, []::VARCHAR[]), (5, []::VARCHAR[]), (6, ['make', 'terraform plan'])) AS t(id, steps)""")
def command_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(COMMANDS)), "id int, command string")
    return rows.select("id", text.command_signatures(F.col("command")).alias("steps"))


def tree(spark: SparkSession) -> DataFrame:
    """A small repository as files(path, content, size, repository)."""
    secret = "Hunter2" + "Pass"
    files = {
        "src/billing.py": f'"""Bills for orders. Uses postgres://admin:{secret}@db.internal/main."""\nimport os\nfrom src import store\n\nMAX_LINES = 40\nDB = os.getenv("DATABASE_URL")\n\n\nclass Bill:\n    """One bill."""\n\n    def total(self):\n        pass\n\n\ndef charge(order, amount):\n    """Charge an order at postgres://admin:{secret}@db.internal/main"""\n',
        "src/store.py": "# Keeps orders\nimport src.billing\n\n\ndef load(key):\n    return key\n",
        "src/empty.py": "",
        "tests/test_billing.py": "from src import billing\nimport src.billing\n\n\ndef test_total():\n    pass\n",
        "web/app.js": "// Copyright 2020 Someone\n\n// Serves the shop\nimport x from './lib/cart'\nconst LIMIT_ROWS = 5;\nexport function start(port) {\n}\napp.get('/health', h);\nconst k = process.env.SHOP_KEY;\n",
        "web/lib/cart.js": "/* The cart */\nexport const add = (item, n) => {\n}\n",
        "api/routes.py": '"""Routes."""\nrouter = APIRouter(prefix="/v1")\n\n@router.get("/orders/{id}")\ndef one(id):\n    pass\n\n@app.route("/ping", methods=["GET", "POST"])\ndef ping():\n    pass\n',
        "models/user.py": "class User(models.Model):\n    pass\n",
        "migrations/001.sql": "-- Orders as placed\nCREATE TABLE orders (\n  id bigint,\n  total numeric\n) PARTITION BY RANGE (id);\nCREATE TABLE orders_1 PARTITION OF orders FOR VALUES FROM (1) TO (2);\nCREATE TABLE orders_2 PARTITION OF orders FOR VALUES FROM (2) TO (3);\nCREATE MATERIALIZED VIEW daily AS SELECT 1;\n",
        "proto/fleet.proto": "service Fleet {\n  rpc Locate(Req) returns (Res);\n  rpc Stop (Req) returns (Res);\n}\n",
        "openapi/shop.yaml": "openapi: 3.0.0\npaths:\n  /carts:\n    get: {}\n  /carts/{id}:\n    get: {}\ninfo: x\n",
        ".env": f"export DATABASE_URL=postgres://u:{secret}@h/d\nAPI_TOKEN={secret}\nlower=1\n",
        ".env.sample": "DATABASE_URL=\nEXTRA_NAME=\n",
        "deploy/shop.yaml": "kind: Deployment\nmetadata:\n  name: shop\nspec:\n    image: registry.local/shop:1.2\n---\nkind: Service\nname: shop\n",
        "deploy/secret.yaml": f"kind: Secret\nmetadata:\n  name: db-login\ndata:\n  password: {secret}\n",
        ".github/workflows/ci.yml": "on: push\njobs:\n  test:\n",
        "roles/web/tasks/main.yml": "- name: install\n",
        "Dockerfile": "FROM scratch\n",
        "secret.pem": "-----BEGIN " + "PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----\n",
        "build/generated.py": "x = 1\n",
        "vendored/inner.py": "# not ours\nx = 1\n",
    } | {f"scans/page{n:02d}.png": "x" * n for n in range(1, 14)}
    rows = [(p, bytearray(c.encode()), len(c.encode()), "vendored" if p.startswith("vendored/") else None) for p, c in files.items()]
    return spark.createDataFrame(rows, "path string, content binary, size long, repository string")


@query("""SELECT * FROM (VALUES
 ('api/routes.py', 'py', 11, TRUE, 'Routes.', 2, 0), ('models/user.py', 'py', 3, TRUE, '', 0, 1), ('proto/fleet.proto', 'proto', 5, TRUE, '', 2, 1),
 ('src/billing.py', 'py', 18, TRUE, 'Bills for orders', 1, 1), ('src/empty.py', 'py', 1, FALSE, '', 0, 0), ('src/store.py', 'py', 7, TRUE, 'Keeps orders', 1, 0),
 ('tests/test_billing.py', 'py', 7, TRUE, '', 1, 0), ('web/app.js', 'js', 10, TRUE, 'Serves the shop', 1, 0), ('web/lib/cart.js', 'js', 4, TRUE, 'The cart', 1, 0)
) AS t(path, lang, lines, describable, doc, n_funcs, n_classes)""")
def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repository.sources(tree(spark))
    return got.select("path", "lang", F.col("lines").cast("int").alias("lines"), "describable", "doc", F.size("funcs").alias("n_funcs"), F.size("classes").alias("n_classes"))


@query("""SELECT * FROM (VALUES ('daily', 'migrations/001.sql', '', []::VARCHAR[]), ('orders', 'migrations/001.sql', 'Orders as placed (partitioned, 2 partitions)', ['id', 'total']), ('User', 'models/user.py', '', []::VARCHAR[])) AS t(name, source, summary, columns)""")
def ddl_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.tables(tree(spark))


@query("""SELECT * FROM (VALUES ('GET', '/v1/orders/{id}', 'api/routes.py'), ('GET', '/ping', 'api/routes.py'), ('POST', '/ping', 'api/routes.py'), ('GET', '/health', 'web/app.js'),
 ('gRPC', 'Fleet/Locate', 'proto/fleet.proto'), ('gRPC', 'Fleet/Stop', 'proto/fleet.proto'), ('ANY', '/carts', 'openapi/shop.yaml'), ('ANY', '/carts/{id}', 'openapi/shop.yaml')) AS t(method, route, source)""")
def route_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.routes(tree(spark))


@query("""SELECT * FROM (VALUES ('API_TOKEN', '.env'), ('DATABASE_URL', '.env'), ('EXTRA_NAME', '.env.sample'), ('SHOP_KEY', 'web/app.js')) AS t(name, source)""")
def env_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.settings(tree(spark))


@query("""SELECT * FROM (VALUES ('ansible', '', 'roles/web/tasks/main.yml', 'roles/web/tasks/main.yml'), ('ci', '', '.github/workflows/ci.yml', '.github/workflows/ci.yml'), ('ci', '', 'Dockerfile', 'Dockerfile'),
 ('images', '', 'registry.local/shop:1.2', 'deploy/shop.yaml'), ('k8s', 'Deployment', 'shop', 'deploy/shop.yaml'), ('k8s', 'Service', 'shop', 'deploy/shop.yaml'), ('k8s', 'Secret', 'db-login', 'deploy/secret.yaml')) AS t("group", kind, name, source)""")
def deployment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.deployed(tree(spark))


@query("""SELECT * FROM (VALUES ('scans', 13, 91, ['.png=13'])) AS t(top, count, bytes, kinds)""")
def stored_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tree(spark)
    claimed = repository.deployed(files).select(F.col("source").alias("path")).distinct()
    got = repository.stored_material(files, repository.sources(files), claimed)
    return got.select("top", F.col("count").cast("int").alias("count"), F.col("bytes").cast("int").alias("bytes"), "kinds")


@query("""SELECT * FROM (VALUES ('src/billing.py', ['src/store.py'], ['tests/test_billing.py']), ('web/lib/cart.js', ['web/app.js'], []::VARCHAR[])) AS t(target, used_by, tests)""")
def repo_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.impact(repository.sources(tree(spark)))


def _cost(shown: str, whole: str) -> str:
    """The note on what a summary costs, in SQL: tokens of what is shown and of the whole text, halves to even."""
    tokens = lambda x: f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"
    ratio = f"CASE WHEN {shown} > 0 AND {whole} > 2 * {shown} THEN ', ' || {tokens(f'{whole} / {shown}')} || 'x less than' ELSE ' of' END"
    return f"'_[~' || {tokens(shown)} || ' tokens' || {ratio} || ' the whole file''s ~' || {tokens(whole)} || ']_'"


def _estimate(text_sql: str) -> str:
    return f"(len(regexp_extract_all({text_sql}, '{text.CJK}')) * 1.00::DOUBLE + len(regexp_extract_all({text_sql}, '{text.DENSE}')) * 0.84::DOUBLE + (length({text_sql}) - len(regexp_extract_all({text_sql}, '{text.CJK}')) - len(regexp_extract_all({text_sql}, '{text.DENSE}'))) / 2.4::DOUBLE)"


def _size(n: str) -> str:
    return f"CASE WHEN {n} < 1024 THEN printf('%.0fB', {n}::DOUBLE) WHEN {n} < 1048576 THEN printf('%.1fKB', {n} / 1024.0::DOUBLE) ELSE printf('%.1fMB', {n} / 1048576.0::DOUBLE) END"


@query(f"""WITH e AS (SELECT 'event' || event_id || '.json' AS path, props, strlen(props) AS n FROM events),
b AS (SELECT path, props, '# ' || path || chr(10) || {_size('n')} || chr(10) || chr(10) || 'structure (keys and types only, no values):' || chr(10) || '  {{k: int}}' AS body FROM e),
c AS (SELECT path, body, {_estimate('body')} AS spent, {_estimate('props')} AS whole FROM b)
SELECT path, body || chr(10) || chr(10) || {_cost('spent', 'whole')} AS summary FROM c""")
def peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties as a JSON file."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("event"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").cast("binary").alias("content"))
    return peek_files(events)


@query(f"""WITH d AS (SELECT 'doc' || doc_id || '.txt' AS path, text, CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END AS t FROM documents),
l AS (SELECT path, text, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(t, chr(10)) END AS lines FROM d),
h AS (SELECT path, text, '# ' || path || chr(10) || {_size('strlen(text)')} || chr(10) || chr(10) || format('{{:,}}', len(lines)) || ' lines' || chr(10) || 'first lines:'
  || coalesce(array_to_string([chr(10) || '  ' || i || ': ' || left(rtrim(lines[i], ' ' || chr(9) || chr(13)), 160) for i in range(1, least(len(lines), 8) + 1)], ''), '') AS raw FROM l),
s AS (SELECT path, text, {duck_scrub('raw')} AS body FROM h),
k AS (SELECT path, text, CASE WHEN length(body) > 959 THEN left(body, 959) || chr(10) || chr(10) || '_[truncated at 400 tokens — narrow it with a search]_' ELSE body END AS body FROM s),
c AS (SELECT path, body, {_estimate('body')} AS spent, {_estimate('text')} AS whole FROM k)
SELECT path, body || chr(10) || chr(10) || {_cost('spent', 'whole')} AS summary FROM c""")
def text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text file: its size, lines, first lines, and what the summary costs. (None of the tables' texts has a dense script.)"""
    return peek_files(table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content")))


@query("""WITH r AS (SELECT c_mktsegment || '.csv' AS path, c_custkey || ',' || c_name || ',' || c_nationkey || ',' || CAST(round(c_acctbal * 100) AS BIGINT) AS line, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer),
t AS (SELECT path, count(*) AS n FROM r GROUP BY 1)
SELECT t.path, '4 columns, ' || format('{:,}', t.n) || ' data rows' AS shape, 'columns: `key`, `name`, `nation`, `cents`' AS header, list('  ' || replace(line, ',', ' | ') ORDER BY r.n) AS sample FROM r JOIN t ON r.path = t.path WHERE r.n <= 3 GROUP BY t.path, t.n""")
def csv_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a CSV file for each segment, and the summary of each file."""
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("c_custkey", "c_name", "c_nationkey")], cents(F.col("c_acctbal")).cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line"))))
    content = F.concat(F.lit("key,name,nation,cents\n"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n"), F.lit("\n"))
    made = table(spark, sf_dir, "customer").groupBy(F.concat("c_mktsegment", F.lit(".csv")).alias("path")).agg(content.cast("binary").alias("content"))
    said = peek_files(made).select("path", F.split("summary", "\n").alias("l"))
    return said.select("path", F.get("l", F.lit(3)).alias("shape"), F.get("l", F.lit(4)).alias("header"), F.slice("l", 7, 3).alias("sample"))


@query("""SELECT * FROM (VALUES ('id_rsa', TRUE, TRUE), ('id_rsa.pub', TRUE, TRUE), ('id_dsa', TRUE, TRUE), ('id_dsa_old', FALSE, TRUE), ('a/server.PEM', TRUE, TRUE), ('data.sqlite', TRUE, FALSE), ('credentials.json', TRUE, TRUE), ('secrets.yml', TRUE, TRUE), ('.netrc', TRUE, TRUE), ('notes.asc', FALSE, TRUE), ('main.py', FALSE, FALSE), ('keys.py', FALSE, FALSE)) AS t(path, blocked, never_opened)""")
def blocked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("id_rsa", "id_rsa.pub", "id_dsa", "id_dsa_old", "a/server.PEM", "data.sqlite", "credentials.json", "secrets.yml", ".netrc", "notes.asc", "main.py", "keys.py")
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    return rows.select("path", redact.is_blocked(F.col("path")).alias("blocked"), redact.is_never_opened(F.col("path")).alias("never_opened"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id + CAST(round(value) AS BIGINT) DESC, event_id) AS k FROM events),
w AS (SELECT CAST(isoyear(ts) AS BIGINT) AS iso_year, CAST(week(ts) AS BIGINT) AS iso_week, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS input, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS output FROM r WHERE k = 1 GROUP BY 1, 2)
SELECT *, 0::BIGINT AS cache_read, 0::BIGINT AS cache_write, output::DOUBLE / calls AS output_per_call, 0::DOUBLE AS cache_read_per_call, 0::DOUBLE AS cache_write_per_call FROM w""")
def usage_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly usage from transcripts: the events written as JSON lines and read back as such."""
    return weekly_usage(_records(spark, sf_dir))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id + CAST(round(value) AS BIGINT) DESC, event_id) AS k FROM events)
SELECT event_type AS model, count(*) AS calls, 0::BIGINT AS cache_read FROM r WHERE k = 1 GROUP BY 1""")
def per_model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_by_model(_records(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.to_json(
        F.struct(
            F.concat_ws("-", "user_id", "event_type").alias("requestId"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
            F.struct(F.concat("event_type", F.lit("-20240101")).alias("model"), F.struct(F.col("event_id").alias("input_tokens"), F.round("value").cast("long").alias("output_tokens")).alias("usage")).alias("message"),
        )
    )
    return usage_records(e.select(line.alias("value"), F.lit("x").alias("path"), F.col("event_id").alias("ord")))


WATCHED = """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "at", CAST(ts AS DATE) AS day, event_type, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S'), event_id) AS n FROM events),
t AS (SELECT user_id, day, max(n) AS last, list(event_type ORDER BY n) AS s FROM e GROUP BY 1, 2),
a AS (SELECT user_id, day, last, s[greatest(1, len(s) - 11):] AS s FROM t), i AS (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM a), j AS (SELECT *, unnest(range(i + 2, len(s) + 1)) AS j FROM i),
whole AS (SELECT DISTINCT user_id, day, last, s[i:j] AS sequence FROM j WHERE len(list_distinct(s[i:j])) >= 3),
p AS (SELECT x.user_id, x.n, x."at", x.day, list(y.event_type ORDER BY y.n) AS s FROM e x JOIN e y ON x.user_id = y.user_id AND x.day = y.day AND y.n <= x.n GROUP BY ALL),
pa AS (SELECT user_id, n, day, s[greatest(1, len(s) - 11):] AS s FROM p), pi AS (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM pa), pj AS (SELECT *, unnest(range(i + 2, len(s) + 1)) AS j FROM pi),
part AS (SELECT DISTINCT user_id, n, day, s[i:j] AS sequence FROM pj WHERE len(list_distinct(s[i:j])) >= 3),
c AS (SELECT e.user_id, e.n, w.sequence, w.day FROM e JOIN whole w ON w.user_id = e.user_id AND w.day < e.day UNION ALL SELECT user_id, n, sequence, day FROM part),
r AS (SELECT user_id, n, sequence, count(DISTINCT day) AS days FROM c GROUP BY ALL HAVING count(DISTINCT day) >= 3),
b AS (SELECT user_id, n, sequence, days FROM (SELECT *, row_number() OVER (PARTITION BY user_id, n ORDER BY len(sequence) DESC, days DESC, sequence) AS k FROM r) WHERE k = 1),
f AS (SELECT e.user_id, e.n, e."at", b.sequence, b.days, lag(b.sequence) OVER (PARTITION BY e.user_id ORDER BY e.n) AS earlier FROM e LEFT JOIN b ON b.user_id = e.user_id AND b.n = e.n)
SELECT CAST(user_id AS VARCHAR) AS repo, "at", sequence, days FROM f WHERE sequence IS NOT NULL AND (earlier IS NULL OR earlier <> sequence)"""


# The oracle looks at whole histories, as no user of the tables has more than the 400 steps that the detector keeps.
@query(WATCHED)
def watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workflow detector over the events as a stream of steps, one repository per user."""
    from ..streaming.watch import drained, watch_workflows

    folder = fresh_path(spark, "watch")
    path = f"{sf_dir}/events.parquet"
    # As a pattern, since a stream's plain path has to be a folder.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    steps = events.select(F.col("user_id").cast("string").alias("repo"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("event_id").alias("ord"), F.array("event_type").alias("steps"))
    return drained(watch_workflows(steps), folder)
