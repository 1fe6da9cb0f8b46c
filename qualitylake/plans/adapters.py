"""Projections of the driver tables to the library's fact tables, in SQL that Spark and DuckDB both read.

The driver tables hold no source code, so functions, coverage lines, findings, imports and paths are deterministic
projections of their rows; page and text jobs read the real `pages` and `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

#: View -> SQL over tables and earlier views.
VIEWS: dict[str, str] = {
    # (l_orderkey, l_linenumber) is not unique: the largest quantity of a pair is its complexity
    "v_functions": """
        SELECT concat('r', CAST(l_orderkey % 20 AS VARCHAR(20))) AS repo, concat('src/f', CAST(l_orderkey AS VARCHAR(20)), '.py') AS file,
               concat('fn', CAST(l_linenumber AS VARCHAR(20))) AS symbol, (l_linenumber - 1) * 50 + 1 AS start_line, l_linenumber * 50 AS end_line,
               CAST(floor(max(l_quantity)) AS INT) AS cc
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_cov_lines": """
        SELECT concat('r', CAST(l_orderkey % 20 AS VARCHAR(20))) AS repo, concat('/ci/build/src/f', CAST(l_orderkey AS VARCHAR(20)), '.py') AS report_path,
               (l_linenumber - 1) * 50 + CAST(floor(l_quantity) AS INT) AS line, max(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS hits
        FROM lineitem WHERE l_linenumber < 7 GROUP BY l_orderkey, (l_linenumber - 1) * 50 + CAST(floor(l_quantity) AS INT)""",
    "v_findings": """
        SELECT concat('r', CAST(user_id % 10 AS VARCHAR(20))) AS repo, CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS run_id, concat('e', CAST(event_id AS VARCHAR(20))) AS id,
               CASE event_type WHEN 'error' THEN 'tests.failed' WHEN 'purchase' THEN 'secrets.token' WHEN 'click' THEN 'a11y.img-alt' WHEN 'view' THEN 'sca.undeclared_dependency' ELSE 'perf.clone' END AS rule,
               CASE event_type WHEN 'error' THEN 'tests' WHEN 'purchase' THEN 'secrets' WHEN 'click' THEN 'a11y' WHEN 'view' THEN 'sca' ELSE 'perf' END AS engine,
               CASE WHEN event_type IN ('error', 'purchase') THEN 'error' ELSE 'warning' END AS severity,
               concat('src/m', CAST(user_id % 50 AS VARCHAR(20))) AS file, CAST(event_id % 400 + 1 AS INT) AS start_line,
               CASE WHEN user_id % 3 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE concat('s', CAST(user_id % 7 AS VARCHAR(20))) END AS symbol,
               concat('issue ', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5 AS VARCHAR(20))) AS message,
               CASE WHEN event_type IN ('error', 'purchase') THEN concat('fix ', event_type) ELSE CAST(NULL AS VARCHAR(20)) END AS suggested_action
        FROM events""",
    # runs with findings, and runs of other days that have none
    "v_runs": "SELECT repo, run_id FROM v_findings UNION SELECT concat('r', CAST(o_custkey % 10 AS VARCHAR(20))) AS repo, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS run_id FROM orders",
    "v_engine_runs": """
        SELECT concat('r', CAST(user_id % 10 AS VARCHAR(20))) AS repo, event_id AS pos,
               CASE event_type WHEN 'error' THEN 'tests' WHEN 'purchase' THEN 'secrets' WHEN 'click' THEN 'a11y' WHEN 'view' THEN 'sca' ELSE 'perf' END AS engine,
               CAST(floor(value * 100) AS BIGINT) AS duration_ms, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code
        FROM events""",
    "v_gates": """
        SELECT repo, run_id, id, n = 0 AS pass, enforced, CASE WHEN n > 0 THEN concat(CAST(n AS VARCHAR(20)), ' ', id) END AS reason
        FROM (SELECT repo, run_id, engine AS id, engine IN ('tests', 'secrets') AS enforced, sum(CASE WHEN severity = 'error' OR engine = 'a11y' THEN 1 ELSE 0 END) AS n
              FROM v_findings GROUP BY repo, run_id, engine) g""",
    # gates and test runs of the twenty repositories that have functions; some failing runs have no exit code
    "v_gates_20": "SELECT concat('r', CAST(o_custkey % 20 AS VARCHAR(20))) AS repo, 'tests' AS id, min(o_custkey % 20) % 2 = 0 AS pass, CASE WHEN min(o_custkey % 20) % 3 = 0 THEN 'two tests failed' END AS reason FROM orders GROUP BY o_custkey % 20",
    "v_runs_20": "SELECT concat('r', CAST(o_custkey % 20 AS VARCHAR(20))) AS repo, 'tests' AS engine, o_orderkey AS pos, CASE WHEN o_custkey % 20 IN (11, 15) THEN CAST(NULL AS INT) WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(o_custkey % 20 + 1 + o_orderkey % 3 AS INT) END AS exit_code FROM orders",
    "v_mutants": """
        SELECT concat('r', CAST(o_custkey % 10 AS VARCHAR(20))) AS repo, o_orderkey AS pos, concat('src/o', CAST(o_custkey % 40 AS VARCHAR(20)), '.rs') AS file,
               CASE o_orderstatus WHEN 'F' THEN 'CaughtMutant' WHEN 'O' THEN 'MissedMutant' ELSE 'Timeout' END AS summary FROM orders""",
    "v_imports": """
        SELECT DISTINCT concat('r', CAST(l_orderkey % 20 AS VARCHAR(20))) AS repo, concat('src/f', CAST(l_orderkey AS VARCHAR(20)), '.py') AS file, concat('p', CAST(l_partkey AS VARCHAR(20))) AS module, l_linenumber AS line FROM lineitem""",
    # what one repository declares or has installed says nothing of another one
    "v_declared": """
        SELECT DISTINCT concat('r', CAST(l_orderkey % 20 AS VARCHAR(20))) AS repo, concat('p', CAST(l_partkey AS VARCHAR(20))) AS module
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 20 AND l_linenumber <= 2""",
    "v_installed": """
        SELECT DISTINCT concat('r', CAST(l_orderkey % 20 AS VARCHAR(20))) AS repo, concat('p', CAST(l_partkey AS VARCHAR(20))) AS module, concat('dist-', CAST(l_partkey AS VARCHAR(20)), CASE WHEN l_linenumber = 3 THEN '' ELSE '-x' END) AS distribution
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size BETWEEN 15 AND 30 AND l_linenumber IN (3, 4)""",
    "v_index": "SELECT concat('p', CAST(p_partkey AS VARCHAR(20))) AS module, concat('dist-', CAST(p_partkey AS VARCHAR(20))) AS distribution, CASE WHEN p_size < 40 THEN 'present' WHEN p_size < 47 THEN 'absent' ELSE 'unchecked' END AS state FROM part WHERE p_size > 25",
    "v_paths": """
        SELECT concat('r', CAST(o_custkey % 10 AS VARCHAR(20))) AS repo,
               concat(CASE o_orderkey % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'vendor/' WHEN 3 THEN 'target/' WHEN 4 THEN 'src/target/' WHEN 5 THEN '.hidden/' WHEN 6 THEN 'src/generated/' ELSE '._' END, 'f', CAST(o_orderkey AS VARCHAR(20)),
                      CASE o_custkey % 9 WHEN 0 THEN '.rs' WHEN 1 THEN '.ts' WHEN 2 THEN '.py' WHEN 3 THEN '.go' WHEN 4 THEN '_test.go' WHEN 5 THEN '.java' WHEN 6 THEN '.sh' WHEN 7 THEN '.txt' ELSE '' END) AS path,
               o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders""",
    "v_changed": "SELECT repo, path, key % 4 = 1 AS is_new_file FROM v_paths WHERE key % 2 = 1",
    "v_commits": """
        SELECT concat('r', CAST(o_custkey % 10 AS VARCHAR(20))) AS repo, concat('c', CAST(o_orderkey AS VARCHAR(20))) AS id,
               concat('change ', CAST(o_orderkey AS VARCHAR(20)), chr(10), chr(10), CASE o_orderstatus WHEN 'F' THEN 'Reviewed-By: someone' WHEN 'O' THEN 'signed-off by nobody' ELSE 'Co-authored-by: clerk' END) AS message
        FROM orders""",
    "v_specs": "SELECT concat('r', CAST(o_custkey % 10 AS VARCHAR(20))) AS repo, o_orderkey, o_orderstatus = 'O' AS odd FROM orders",
    "v_pages_mut": """
        SELECT page_id, url,
               CASE WHEN page_id % 7 = 0 THEN replace(replace(replace(replace(h4, '<nav>', '<div>'), '</nav>', '</div>'), '<footer>', '<div>'), '</footer>', '</div>') ELSE h4 END AS html
        FROM (SELECT page_id, url, CASE WHEN page_id % 6 = 0 THEN replace(h3, '</h1>', concat('</h1>', '<input id="q"><input id="r" type="text"><input type="hidden"><label for="r">r</label><a href="#top"></a><a href="#end" aria-label="end"></a><div tabindex="3"></div><div tabindex="-1"></div><video autoplay src="v.mp4"></video><video autoplay controls src="w.mp4"></video>',
                 '<i style="color: #777777; background: #888888"></i><i style="color: black; background: white"></i><style>em { color: #999; background-color: #aaa }</style><em></em>')) ELSE h3 END AS h4
        FROM (SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN replace(h2, '<article>', '<article><div id="one"></div><div id="one"></div>') ELSE h2 END AS h3
        FROM (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN replace(h1, '</h1>', '</h1><img src="a.png"><h3>x</h3>') ELSE h1 END AS h2
        FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '<html lang="[a-z]*">', '<html>') ELSE html END AS h1 FROM pages) a) b) c) d""",
}


def _needs(name: str) -> list[str]:
    import re

    return re.findall(r"\bv_\w+", VIEWS[name])


def ordered(names: list[str]) -> list[str]:
    """The views and those they read, each after what it reads."""
    out: list[str] = []
    for n in names:
        for x in [*ordered(_needs(n)), n]:
            if x not in out:
                out.append(x)
    return out


def with_views(names: list[str], sql: str) -> str:
    """A statement that has the views as common table expressions."""
    if not names:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered(names)) + "\n" + sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or an adapter view of a data directory."""
    if name in VIEWS:
        for t in TABLES:
            if any(t in VIEWS[v] for v in ordered([name])):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(with_views(ordered(_needs(name)), VIEWS[name]))
    return table(spark, sf_dir, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """A frame that several branches of a query read: written once where the session names a shared checkpoint
    folder, else computed wherever it is read."""
    return df.checkpoint() if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else df
