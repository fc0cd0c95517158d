"""The registered queries in SQL for a second engine, written independently.

Every text starts from the base tables: the derived views come first as CTEs.
"""

from __future__ import annotations

import re

from grovelark.plans.derived import BASE, VIEWS, needed_views, other_engine

NL = "chr(10)"
WS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
STAMP = "2024-01-01 00:00:00"


def _extract_all(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


# Fixed patterns of the import forms, as in grovelark.functions.fixed_values
JS_FROM = r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]"""
JS_BARE = r"""import\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
TS_TYPE = r"""import\s+type\s+.*?\s+from\s+['"]([^'"]+)['"]"""


def _imports(ext: str, pattern: str, kind: str = "import", detail: str = "CAST(NULL AS STRING)") -> str:
    return (
        f"SELECT repo, relative_path AS source, unnest({_extract_all('content', pattern, 1)}) AS target, "
        f"'{kind}' AS dep_type, {detail} AS detail FROM code WHERE ext = '{ext}'"
    )


def _script(ext: str) -> str:
    whole = f"unnest({_extract_all('content', JS_FROM, 0)})"
    return " UNION ALL ".join([_imports(ext, JS_FROM, detail=whole), _imports(ext, JS_BARE), _imports(ext, JS_REQUIRE)])


IMPORTS = {
    "python": _imports(".py", r"(?m)^\s*import\s+([\w.]+)") + " UNION ALL " + _imports(".py", r"(?m)^\s*from\s+([\w.]+)\s+import"),
    "javascript": _script(".js"),
    "typescript": _script(".ts") + " UNION ALL " + _imports(".ts", TS_TYPE, detail="'type import'"),
    "java": _imports(".java", r"(?m)^\s*import\s+([\w.]+)\s*;")
    + " UNION ALL " + _imports(".java", r"class\s+\w+\s+extends\s+(\w+)", "extends")
    + r" UNION ALL SELECT repo, relative_path, trim(unnest(string_split(regexp_extract(content, 'class\s+\w+.*?implements\s+([\w,\s]+)', 1), ','))), 'implements', NULL FROM code WHERE ext = '.java'",
    "go": _imports(".go", r'import\s+"([^"]+)"')
    + r""" UNION ALL SELECT repo, relative_path, unnest(regexp_extract_all(regexp_extract(content, '(?s)import\s+\((.*?)\)', 1), '"([^"]+)"', 1)), 'import', NULL FROM code WHERE ext = '.go'""",
}

_BADGE = f"""CASE WHEN module = 'apiserver' THEN 'Api Server' WHEN module = 'mqtt_tool' THEN 'Mqtt  Tool'
  WHEN module = 'voice' THEN 'Voice' WHEN module = 'data-hub' THEN 'Data Hub' ELSE upper(module) END"""
_KEY = r"CASE WHEN regexp_matches(upper(api), '^\s*\S+\s+\S') THEN concat(regexp_extract(upper(api), '(?s)^\s*(\S+)\s+(\S.*)$', 1), ' ', split_part(regexp_extract(upper(api), '(?s)^\s*(\S+)\s+(\S.*)$', 2), '(', 1)) ELSE upper(api) END"
_FILE_DONE = "type IN ('analysis_file_complete', 'analysis_file_failed')"

# helper CTEs on top of the derived views
HELPERS: dict[str, str] = {
    "split_files": "SELECT *, string_split(relative_path, '/') AS parts, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext FROM {files}",
    "judged": """SELECT *, len(list_filter(parts, lambda s: starts_with(s, '.') OR ends_with(s, '.log') OR ends_with(s, '.pyc') OR ends_with(s, '.tmp'))) > 0
        OR len(list_intersect(parts[1:len(parts) - 1], ['node_modules', '__pycache__', 'venv', 'dist', 'build'])) > 0 AS ignored FROM {split_files}""",
    "kept": "SELECT * FROM {judged} WHERE NOT ignored AND ext IN ('.py', '.js', '.ts', '.java')",
    "dirs": """SELECT DISTINCT repo, d AS relative_path FROM (
        SELECT repo, unnest(list_transform(range(0, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS d FROM {kept}) x""",
    "all_dirs": """SELECT DISTINCT repo, d AS relative_path FROM (
        SELECT repo, unnest(list_transform(range(0, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS d FROM {split_files}) x""",
    "nodes": """SELECT repo, relative_path, parts, array_to_string(parts[1:len(parts) - 1], '/') AS parent_path, parts[len(parts)] AS name,
        CAST(CASE WHEN relative_path = '' THEN 0 ELSE len(parts) END AS INTEGER) AS depth, node_type,
        CASE WHEN node_type = 'file' THEN concat('docs/', relative_path, '.md') WHEN relative_path = '' THEN 'docs/_dir_summary.md'
             ELSE concat('docs/', relative_path, '/_dir_summary.md') END AS doc_path
        FROM (SELECT repo, relative_path, parts, 'file' AS node_type FROM {kept}
              UNION ALL SELECT repo, relative_path, string_split(relative_path, '/'), 'directory' FROM {dirs}) x""",
    "tokens": """SELECT *, concat(CASE WHEN node_type = 'file' THEN '1' ELSE '0' END, lower(name), chr(2), name) AS token,
        CASE WHEN relative_path = '' THEN '' ELSE array_to_string(list_transform(range(1, len(parts) + 1), lambda i:
          concat(CASE WHEN node_type = 'file' AND i = len(parts) THEN '1' ELSE '0' END, lower(parts[i]), chr(2), parts[i])), chr(1)) END AS preorder FROM {nodes}""",
    "listing": """SELECT t.repo, t.relative_path, t.preorder,
        CASE WHEN t.relative_path = '' THEN concat(t.repo, '/') ELSE
          concat(coalesce(p.bars, ''), CASE WHEN t.is_last THEN '└── ' ELSE '├── ' END, t.name, CASE WHEN t.node_type = 'directory' THEN '/' ELSE '' END) END AS line
        FROM {marked} t LEFT JOIN (
          SELECT u.repo, u.relative_path, string_agg(CASE WHEN m.is_last THEN '    ' ELSE '│   ' END, '' ORDER BY m.depth) AS bars
          FROM (SELECT repo, relative_path, unnest(list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS step FROM {marked}) u
          JOIN {marked} m ON m.repo = u.repo AND m.relative_path = u.step AND m.node_type = 'directory'
          GROUP BY u.repo, u.relative_path) p USING (repo, relative_path)""",
    "marked": "SELECT *, token = max(token) OVER (PARTITION BY repo, parent_path, relative_path = '') AS is_last FROM {tokens}",
    "kids": """SELECT repo, parent_path AS relative_path, count(*) FILTER (node_type = 'file') AS file_count,
        count(*) FILTER (node_type = 'directory') AS dir_count FROM {nodes} WHERE relative_path <> '' GROUP BY ALL""",
    "changes": """SELECT coalesce(n.repo, o.repo) AS repo, coalesce(n.relative_path, o.relative_path) AS path,
        CASE WHEN o.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'deleted' ELSE 'modified' END AS change_type,
        md5(o.content) AS old_hash, md5(n.content) AS new_hash
        FROM {files_new} n FULL JOIN {files_old} o ON n.repo = o.repo AND n.relative_path = o.relative_path
        WHERE o.repo IS NULL OR n.repo IS NULL OR md5(o.content) <> md5(n.content)""",
    "affected": """SELECT repo, 'file' AS node_type, path AS relative_path FROM {changes} WHERE change_type <> 'deleted'
        UNION ALL SELECT DISTINCT repo, 'directory', d FROM (SELECT repo, unnest(list_transform(range(0, len(string_split(path, '/'))),
          lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS d FROM {changes}) x""",
    "new_nodes": """SELECT repo, relative_path, 'file' AS node_type FROM {files_new}
        UNION ALL SELECT DISTINCT repo, d, 'directory' FROM (SELECT repo, unnest(list_transform(range(0, len(string_split(relative_path, '/'))),
          lambda i: array_to_string(string_split(relative_path, '/')[1:i], '/'))) AS d FROM {files_new}) x""",
    "remarked": """SELECT n.repo, n.relative_path, n.node_type, CASE WHEN a.repo IS NULL THEN 'completed' ELSE 'pending' END AS status
        FROM {new_nodes} n LEFT JOIN {affected} a USING (repo, relative_path, node_type)""",
    "records": """SELECT repo, kind AS node_type, key AS relative_path, coalesce(bool_or(value = 'completed'), false) AS completed,
        coalesce(max(CASE WHEN value = 'failed' THEN seq END) > coalesce(max(CASE WHEN value = 'completed' THEN seq END), -1), false) AS failed,
        arg_max(value, seq) AS status FROM {state_log} WHERE kind IN ('file', 'directory') GROUP BY ALL""",
    "latest": "SELECT * FROM {state_log} QUALIFY row_number() OVER (PARTITION BY repo, kind, key ORDER BY seq DESC) = 1",
    "restored": """SELECT n.repo, n.relative_path, n.node_type, n.depth, n.name,
        CASE WHEN r.completed AND d.repo IS NOT NULL THEN 'completed' WHEN r.failed THEN 'failed' ELSE 'pending' END AS status,
        CASE WHEN r.completed AND d.repo IS NOT NULL THEN n.doc_path END AS doc_path,
        coalesce(r.completed AND d.repo IS NOT NULL AND i.value IS NOT NULL, false) AS has_api,
        CASE WHEN r.completed AND d.repo IS NOT NULL THEN i.value END AS api_info
        FROM {nodes} n LEFT JOIN {records} r USING (repo, node_type, relative_path)
        LEFT JOIN (SELECT repo, doc_path FROM {docs}) d USING (repo, doc_path)
        LEFT JOIN (SELECT repo, key AS relative_path, value FROM {latest} WHERE kind = 'api_info') i USING (repo, relative_path)""",
    "api_list": "SELECT repo, key AS relative_path, value FROM {latest} WHERE kind = 'api_info' AND value IS NOT NULL",
    "detail_list": "SELECT repo, key AS relative_path, value FROM {latest} WHERE kind = 'api_details' AND value IS NOT NULL",
    "edges": " UNION ALL ".join(IMPORTS.values()).replace("FROM code", "FROM {code}"),
    "resolved": r"""SELECT e.repo, e.source, e.target, e.dep_type, c.relative_path AS resolved FROM {edges} e LEFT JOIN {code} c
        ON c.repo = e.repo AND c.relative_path = CASE
          WHEN e.source LIKE '%.py' THEN concat(replace(e.target, '.', '/'), '.py')
          WHEN e.source LIKE '%.java' AND e.dep_type = 'import' THEN concat(replace(e.target, '.', '/'), '.java')
          WHEN e.source LIKE '%.go' THEN concat(e.target, '.go')
          WHEN e.target LIKE './%' THEN concat(split_part(e.source, '/', 1), '/', substr(e.target, 3), regexp_extract(e.source, '\.[a-z]+$')) END""",
    "links": "SELECT repo, source, unnest(targets) AS target, 'import' AS dep_type FROM {page_links}",
    "link_nodes": "SELECT repo, source AS node FROM {links} UNION SELECT repo, target FROM {links}",
    "edge_nodes": "SELECT repo, source AS node FROM {edges} UNION SELECT repo, target FROM {edges}",
    "blocks": rf"""SELECT repo, relative_path, trim(CASE WHEN regexp_matches(content, '(?si)<!--\s*API_START\s*-->(.*?)<!--\s*API_END\s*-->')
          THEN regexp_extract(content, '(?si)<!--\s*API_START\s*-->(.*?)<!--\s*API_END\s*-->', 1)
          WHEN regexp_matches(content, '(?i)<!--\s*API_START\s*-->') THEN regexp_extract(content, '(?si)<!--\s*API_START\s*-->(.*)', 1) END, {WS}) AS block FROM {{source_docs}}""",
    "judged_blocks": r"""SELECT *, CASE WHEN block IS NULL OR contains(block, '包含API接口: 否') OR contains(block, '包含API接口：否') THEN false
          WHEN contains(block, '包含API接口: 是') OR contains(block, '接口列表') THEN true
          ELSE regexp_matches(block, '\[[A-Za-z一-龥_]+\]\s*[/\w]') OR regexp_matches(block, '(?i)/api/|/v\d+/') END AS has_api FROM {blocks}""",
    "info_lines": """SELECT repo, source_file, trim(unnest(string_split(info_text, chr(10)))) AS line,
        generate_subscripts(string_split(info_text, chr(10)), 1) - 1 AS pos FROM {api_info}""",
    "apis": r"""SELECT repo, source_file, pos, CASE WHEN contains(source_file, '/') THEN split_part(source_file, '/', 1) ELSE replace(source_file, '.py', '') END AS module,
        trim(g[1]) AS method, trim(g[2]) AS path, trim(g[3]) AS "desc" FROM (
          SELECT *, [regexp_extract(line, p, 1), regexp_extract(line, p, 2), regexp_extract(line, p, 3)] AS g FROM (
            SELECT *, '^-\s*`?\[([^\]]+)\]\s*([^\s(`-]+(?:\([^)]*\)|(?:\s*\{[^}]+\}))?)`?\s*(?:[-→]\s*(.*))?$' AS p FROM {info_lines}) y
          WHERE regexp_matches(line, p)) z""",
    "overview_numbered": r"""SELECT repo, doc, trim(num) AS num, concat(trim(method), ' ', trim(path)) AS api, pos FROM (
          SELECT repo, doc, unnest(regexp_extract_all(content, p, 1)) AS num, unnest(regexp_extract_all(content, p, 3)) AS method,
                 unnest(regexp_extract_all(content, p, 4)) AS path, generate_subscripts(regexp_extract_all(content, p, 0), 1) AS pos
          FROM (SELECT *, '(?m)^\|\s*(\d+)\s*\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|' AS p FROM {overview_docs}) x) y
        WHERE trim(method) <> '' AND trim(path) <> '' QUALIFY row_number() OVER (PARTITION BY repo, doc, trim(num) ORDER BY pos) = 1""",
    "overview_simple": r"""SELECT repo, doc, concat(trim(method), ' ', trim(path)) AS api, pos FROM (
          SELECT repo, doc, unnest(regexp_extract_all(content, p, 1)) AS method, unnest(regexp_extract_all(content, p, 2)) AS path,
                 generate_subscripts(regexp_extract_all(content, p, 0), 1) AS pos
          FROM (SELECT *, '(?m)^\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|' AS p FROM {overview_docs}) x) y
        WHERE trim(method) NOT IN ('方法', '序号', '---', '') AND NOT starts_with(trim(method), '-') AND trim(path) NOT IN ('路径', '---', '') AND NOT starts_with(trim(path), '-')""",
    "overview_items": r"""SELECT repo, doc, concat(method, ' ', path) AS api, pos FROM (
          SELECT repo, doc, unnest(regexp_extract_all(content, p, 1)) AS method, unnest(regexp_extract_all(content, p, 2)) AS path,
                 generate_subscripts(regexp_extract_all(content, p, 0), 1) AS pos
          FROM (SELECT *, '-\s*`?([A-Za-z一-龥]+)\s+([^\s`]+)`?' AS p FROM {overview_docs}) x) y WHERE lower(method) NOT IN ('the', 'a', 'an', 'is', 'are')""",
    "overview": """SELECT repo, doc, api, pos FROM {overview_numbered}
        UNION ALL SELECT repo, doc, api, pos FROM {overview_simple} s WHERE NOT EXISTS (SELECT 1 FROM {overview_numbered} n WHERE n.repo = s.repo AND n.doc = s.doc)
        UNION ALL SELECT repo, doc, api, pos FROM {overview_items} s WHERE NOT EXISTS (SELECT 1 FROM {overview_numbered} n WHERE n.repo = s.repo AND n.doc = s.doc)
          AND NOT EXISTS (SELECT 1 FROM {overview_simple} n WHERE n.repo = s.repo AND n.doc = s.doc)""",
    "usage_lines": """SELECT repo, doc, trim(unnest(string_split(content, chr(10)))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM {usage_docs}""",
    "usage_heads": r"""SELECT repo, doc, pos, trim(regexp_extract(line, '^(#{2,4})\s+(.+)$', 2)) AS head FROM (
          SELECT *, max(regexp_matches(line, '(?i)\*\*功能(描述)?\*\*(：|:)|\*\*认证(要求)?\*\*(：|:)')::INT) OVER (
            PARTITION BY repo, doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING) AS meta FROM {usage_lines}) x
        WHERE meta = 1 AND regexp_matches(line, '^(#{2,4})\s+(.+)$')""",
    "usage_named": r"""SELECT repo, doc, concat(method, ' ', path) AS api FROM (
          SELECT repo, doc,
            CASE WHEN regexp_matches(head, b) THEN regexp_extract(head, b, 1) WHEN regexp_matches(head, n) THEN regexp_extract(head, n, 1) ELSE regexp_extract(head, p, 1) END AS method,
            CASE WHEN regexp_matches(head, b) THEN regexp_extract(head, b, 2) WHEN regexp_matches(head, n) THEN regexp_extract(head, n, 2) ELSE regexp_extract(head, p, 2) END AS path
          FROM (SELECT *, '^接口\d+\s*[:\s]\s*\[([^\]]+)\]\s*(.+)$' AS b, '(?i)^接口\d+\s*[:\s]\s*(GET|POST|PUT|DELETE|PATCH|MCP工具)\s+(.+)$' AS n,
                '^([^\s:]+)[:\s]+(/[^\s]*|[a-zA-Z_][a-zA-Z0-9_]*)(?:\s|$)' AS p FROM {usage_heads}) x) y WHERE method <> '' AND path <> ''""",
    "usage": r"""SELECT repo, doc, 'heading' AS origin, api FROM {usage_named}
        UNION ALL SELECT repo, doc, 'table', api FROM (
          SELECT repo, doc, concat(trim(regexp_extract(line, p, 1)), ' ', trim(regexp_extract(line, p, 2))) AS api FROM (
            SELECT *, '^\|\s*([^|]+)\s*\|\s*(/[^|]+)\s*\|' AS p FROM {usage_lines}) x WHERE regexp_matches(line, p)) t
        WHERE NOT EXISTS (SELECT 1 FROM {usage_named} u WHERE u.repo = t.repo AND u.doc = t.doc AND upper(u.api) = upper(t.api))""",
    "module_lines": """SELECT repo, doc, trim(unnest(string_split(content, chr(10)))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM {module_lists}""",
    "module_heads": r"""SELECT *, CASE WHEN starts_with(line, '###') AND NOT contains(line, '|') THEN
          CASE WHEN regexp_matches(line, '^###\s+\d+(?:\.\d+)+\s+(.+)$') THEN trim(regexp_extract(line, '^###\s+\d+(?:\.\d+)+\s+(.+)$', 1))
               WHEN regexp_matches(line, '^###\s+([^\d#].*)$') THEN trim(regexp_extract(line, '^###\s+([^\d#].*)$', 1)) END END AS head FROM {module_lines}""",
    "module_rows": r"""SELECT repo, doc, module, section, concat(trim(regexp_extract(line, p, 1)), ' ', trim(regexp_extract(line, p, 2))) AS api FROM (
          SELECT *, last_value(head IGNORE NULLS) OVER w AS module, count(head) OVER w AS section, '^\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|' AS p
          FROM {module_heads} WINDOW w AS (PARTITION BY repo, doc ORDER BY pos ROWS UNBOUNDED PRECEDING)) x
        WHERE head IS NULL AND module IS NOT NULL AND regexp_matches(line, p) AND trim(regexp_extract(line, p, 1)) NOT IN ('方法', '---', '')
          AND NOT starts_with(trim(regexp_extract(line, p, 1)), '-')""",
    "modules": """SELECT DISTINCT repo, doc, module, api FROM {module_rows} r
        WHERE section = (SELECT max(section) FROM {module_rows} s WHERE s.repo = r.repo AND s.doc = r.doc AND s.module = r.module)""",
    "heading_apis": r"""SELECT repo, doc, concat(unnest(regexp_extract_all(content, '(?m)^#{3,4}\s+(GET|POST|PUT|DELETE|PATCH)\s+(/[^\s]*)', 1)), ' ',
          unnest(regexp_extract_all(content, '(?m)^#{3,4}\s+(GET|POST|PUT|DELETE|PATCH)\s+(/[^\s]*)', 2))) AS api FROM {usage_docs}
        UNION SELECT repo, doc, concat('MCP ', unnest(regexp_extract_all(content, '(?mi)^#{3,4}\s+(?:\[)?MCP[^\]]*(?:\])?\s*[:\s]+([\p{L}\p{N}_]+)', 1))) FROM {usage_docs}""",
    "ordered": "SELECT *, struct_pack(t := ts, s := seq) AS o FROM {progress}",
}

# the same tree for two snapshots, with every document, and what each directory is told by its children
for _side in ("old", "new"):
    _of = {"files": f"files_{_side}", **{n: f"{_side}_{n}" for n in ("split_files", "judged", "kept", "dirs", "nodes", "kids")}}
    for _name in list(_of)[1:]:
        HELPERS[_of[_name]] = re.sub(r"\{(\w+)\}", lambda m: "{" + _of.get(m[1], m[1]) + "}", HELPERS[_name])  # noqa: B023
# a whole run over the documents with endpoint notes
HELPERS["run_api"] = "SELECT repo, relative_path AS source_file, block FROM {judged_blocks} WHERE has_api AND repo <> 'r2'"
HELPERS["run_lines"] = HELPERS["info_lines"].replace("info_text", "block").replace("{api_info}", "{run_api}")
HELPERS["run_apis"] = HELPERS["apis"].replace("{info_lines}", "{run_lines}")
HELPERS["run_numbered"] = "SELECT *, row_number() OVER (PARTITION BY repo ORDER BY source_file, pos) AS n FROM {run_apis}"
HELPERS["run_usage"] = f"SELECT repo, source_file, concat('### GET /doc/', source_file, {NL}, '**功能**: x') AS details FROM {{run_api}} WHERE repo = 'r0'"
HELPERS["run_tree"] = """SELECT repo, count(*) AS n FROM (
    SELECT repo, relative_path FROM {source_docs} UNION SELECT repo, unnest(list_transform(range(0, len(string_split(relative_path, '/'))),
      lambda i: array_to_string(string_split(relative_path, '/')[1:i], '/'))) FROM {source_docs}) t GROUP BY repo"""

_WITH_HELPERS = {**VIEWS, **HELPERS}


def _names(sql: str) -> list[str]:
    return [n for n in re.findall(r"\{(\w+)\}", sql) if n in _WITH_HELPERS or n in BASE]


def _fill(sql: str) -> str:
    for n in set(_names(sql)):
        sql = sql.replace("{" + n + "}", n)
    return sql


def build(body: str) -> str:
    """A query with everything it needs in front of it."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in BASE or name in order:
            return
        if name in VIEWS:
            for v in needed_views([name]):
                if v not in order:
                    order.append(v)
            return
        for n in _names(HELPERS[name]):
            add(n)
        order.append(name)

    for name in _names(body):
        add(name)
    ctes = [f"{n} AS ({other_engine(n) if n in VIEWS else _fill(HELPERS[n])})" for n in order]
    if body.startswith("WITH "):
        body = f"SELECT * FROM ({body}) q"
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + _fill(body)


def _parts(source: str, group: str, order: str, text: str, sep: str, size: int, extra: str = "") -> str:
    """Ordered join in parts of ``size`` rows."""
    return (
        f"SELECT {group}, CAST((n - 1) // {size} AS BIGINT) AS part, string_agg(t, {sep} ORDER BY n) AS text, count(*) AS n_rows{extra} FROM ("
        f"SELECT *, {text} AS t, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS n FROM {source}) q GROUP BY {group}, (n - 1) // {size}"
    )


_SEP = "concat(chr(10), chr(10), '---', chr(10), chr(10))"
_LINES = r"len(regexp_extract_all(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) + CASE WHEN content <> '' AND NOT regexp_matches(content, '(?:[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z') THEN 1 ELSE 0 END"
_STANDIN = f"concat('[模拟分析] 文件: ', relative_path, {NL}, '代码行数: ', {_LINES})"
_FILE_DOC = f"concat('# 文件分析: ', name, {NL}, {NL}, '**源文件**: `', relative_path, '`', {NL}, '**生成时间**: {STAMP}', {NL}, {NL}, '---', {NL}, {NL}, {_STANDIN})"


def _dir_doc(summary: str) -> str:
    nm = "CASE WHEN n.relative_path = '' THEN n.repo ELSE n.name END"
    return (
        f"concat('# 目录分析: ', {nm}, {NL}, {NL}, '**目录路径**: `', CASE WHEN n.relative_path = '' THEN n.repo ELSE n.relative_path END, '`', {NL}, "
        f"'**子文件数**: ', k.file_count, {NL}, '**子目录数**: ', k.dir_count, {NL}, '**生成时间**: {STAMP}', {NL}, {NL}, '---', {NL}, {NL}, {summary.format(nm=nm)})"
    )


_GROUP = "CASE WHEN contains(source_file, '/') THEN split_part(source_file, '/', 1) ELSE 'root' END"
_GROUP_NAME = "CASE grp WHEN 'apiserver' THEN 'API服务接口' WHEN 'mqtt_tool' THEN 'MQTT工具接口' WHEN 'voice' THEN '语音服务接口' WHEN 'root' THEN '根目录接口' ELSE 'Data Hub接口' END"
_GROUPED = _parts(
    f"(SELECT *, {_GROUP} AS grp FROM {{details}})", "repo, grp", "source_file",
    f"concat({NL}, '> 来源: `', source_file, '`', {NL}, {NL}, details, {NL}, {NL})", NL, 8,
)
_HEADINGS = f"SELECT repo, grp, concat({NL}, '### 2.', row_number() OVER (PARTITION BY repo ORDER BY grp), ' ', {_GROUP_NAME}, {NL}) AS heading FROM (SELECT DISTINCT repo, {_GROUP} AS grp FROM {{details}}) g"
_QUICK = f"""CASE WHEN s > 0 AND trim(substr(content, s, least(CASE WHEN e2 > s THEN e2 ELSE 1000000000 END, CASE WHEN e3 > s THEN e3 ELSE 1000000000 END,
  CASE WHEN e4 > s THEN e4 ELSE 1000000000 END, length(content) + 1) - s), {WS}) <> ''
  THEN trim(substr(content, s, least(CASE WHEN e2 > s THEN e2 ELSE 1000000000 END, CASE WHEN e3 > s THEN e3 ELSE 1000000000 END,
  CASE WHEN e4 > s THEN e4 ELSE 1000000000 END, length(content) + 1) - s), {WS})
  ELSE concat('## 一、快速开始', {NL}, {NL}, '请参考各接口的请求示例进行调用。', {NL}) END"""
_TAIL = f"""CASE WHEN er > 0 THEN concat({NL}, {NL}, trim(substr(content, er), {WS})) WHEN ex > 0 THEN concat({NL}, {NL}, trim(substr(content, ex), {WS}))
  ELSE concat({NL}, {NL}, '## 三、错误处理', {NL}, {NL}, '请参考各接口文档中的错误响应说明。', {NL}) END"""
_MERGED = f"""CASE WHEN s > 0 THEN trim(substr(content, s, CASE WHEN er > 0 THEN er WHEN ex > 0 THEN ex ELSE length(content) + 1 END - s), {WS})
  WHEN starts_with(content, '## 三') THEN concat('## 一、快速开始', {NL}, {NL}, '（快速开始内容待补充）')
  ELSE trim(regexp_replace(content, '(?ms)^## [三四].*', ''), {WS}) END"""
_MARKS = """(SELECT *, strpos(content, '## 一、快速开始') AS s, strpos(content, '## 二、') AS e2, strpos(content, '## 三、') AS e3, strpos(content, '## 四、') AS e4,
  strpos(content, '## 三、错误处理') AS er, strpos(content, '## 四、调用示例') AS ex FROM {common_docs}) m"""
_MODULES = r"CASE WHEN regexp_matches(content, '##\s*二、按模块分类') THEN regexp_extract(content, '(?si)(##\s*二、按模块分类.*)', 1) END"
_PCT = "CASE WHEN total > 0 THEN round_even(current / total * 100, 1) ELSE 0.0 END"
_ENDS = "('analysis_complete', 'analysis_error')"
_NAMES = "CASE {t} WHEN 'analysis_complete' THEN 'completed' WHEN 'analysis_error' THEN 'failed' WHEN 'task_cancelled' THEN 'cancelled' END"
_TASK_STATE = f"""SELECT task_id, arg_max({_PCT}, o) FILTER (type = 'analysis_progress') AS percentage,
  arg_max(file_path, o) FILTER (type = 'analysis_progress') AS current_file,
  coalesce({_NAMES.format(t=f"arg_max(type, o) FILTER (type IN {_ENDS})")}, 'running') AS status,
  arg_max(error, o) FILTER (type = 'analysis_error') AS error FROM {{ordered}} GROUP BY task_id"""
_NODE_STATUS = f"""SELECT task_id, file_path, CASE WHEN arg_max(type, o) = 'analysis_file_complete' THEN 'completed' ELSE 'failed' END AS status
  FROM {{ordered}} WHERE {_FILE_DONE} GROUP BY task_id, file_path"""
_LEVELS = """SELECT task_id, depth, count(*) FILTER (type = 'analysis_file_complete' AND node_type = 'file') AS completed_files,
  count(*) FILTER (type = 'analysis_file_complete' AND node_type <> 'file') AS completed_dirs,
  count(*) FILTER (type = 'analysis_file_failed') AS failed FROM {progress} GROUP BY task_id, depth"""
_LIFE = f"""SELECT task_id, min(ts) AS created_at, min(ts) FILTER (type = 'analysis_started') AS started_at,
  arg_min(ts, o) FILTER (type IN ('analysis_complete', 'analysis_error', 'task_cancelled')) AS completed_at,
  coalesce({_NAMES.format(t="arg_min(type, o) FILTER (type IN ('analysis_complete', 'analysis_error', 'task_cancelled'))")},
    CASE WHEN min(ts) FILTER (type = 'analysis_started') IS NOT NULL THEN 'running' END, 'pending') AS status FROM {{ordered}} GROUP BY task_id"""
_LIST = "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY preorder) AS line_no, line FROM {listing}"
_UNION_SIDES = "(SELECT {by}, {key} AS key, count(*) AS a, 0 AS b FROM {{overview}} GROUP BY ALL UNION ALL SELECT {by}, {key}, 0, count(*) FROM {{usage}} GROUP BY ALL) u"


def _gaps(by: str) -> str:
    inner = _UNION_SIDES.format(by=by, key=_KEY).replace("{{", "{").replace("}}", "}")
    return f"SELECT {by}, key, CAST(greatest(sum(a) - sum(b), 0) AS BIGINT) AS missing, CAST(greatest(sum(b) - sum(a), 0) AS BIGINT) AS extra FROM {inner} GROUP BY ALL HAVING sum(a) <> sum(b)"


_FOOT = f"{NL}, {NL}, '---', {NL}, {NL}, '*本文档由 grovelark 自动生成*', {NL}, '*生成时间: {STAMP}*', {NL}"
_RUN_GROUPED = _GROUPED.replace("{details}", "{run_usage}")
_RUN_HEADINGS = _HEADINGS.replace("{details}", "{run_usage}")
_RUN_TEXTS = f"""
    SELECT 'r0' AS repo, 'readme' AS kind, '0' AS block, 0 AS part, concat('# r0', {NL}, {NL}, '[模拟README]', {NL}, {NL}, '路径: r0', {_FOOT}) AS text
    UNION ALL SELECT repo, 'reading_guide', '0', 0, concat('# ', repo, ' - 文档阅读顺序指南', {NL}, {NL}, '> 本指南帮助你按照合理的顺序阅读项目文档，快速理解项目结构和核心逻辑。', {NL}, {NL}, '---', {NL}, {NL},
      '[模拟指南] 结构行数: ', n, {_FOOT}) FROM {{run_tree}} WHERE repo <> 'r2'
    UNION ALL SELECT DISTINCT repo, 'api_doc', '0', 0, concat('# ', repo, ' - API接口清单', {NL}, {NL}, '> 本文档列出项目的所有API接口及其功能描述。', {NL}, '> 注意：本文档仅包含接口清单，不包含详细的请求/响应示例。', {NL}, {NL}, '---', {NL}, {NL},
      '# ', repo, ' API接口文档', {NL}, {NL}, '## 一、接口总览', {NL}, {NL}, '| 序号 | 模块 | 方法 | 路径 | 功能描述 | 认证 |', {NL}, '|------|------|------|------|----------|------|', {NL}) FROM {{run_api}}
    UNION ALL SELECT repo, 'api_doc', '1', (n - 1) // 8, concat(string_agg(concat('| ', n, ' | ', {_BADGE}, ' | ', method, ' | ', path, ' | ', "desc", ' | 否 |'), {NL} ORDER BY n), {NL}) FROM {{run_numbered}} GROUP BY repo, (n - 1) // 8
    UNION ALL SELECT repo, 'api_doc', '2', 0, concat({NL}, '**接口总计：', (SELECT count(*) FROM {{run_apis}} a WHERE a.repo = r.repo), ' 个**', {NL}, {NL}, '## 二、按模块分类', {NL}, {NL}, '[模拟汇总] 文件数: ', count(*), {_FOOT}) FROM {{run_api}} r GROUP BY repo
    UNION ALL SELECT 'r0', 'api_usage_doc', '', 0, concat('# r0 API使用文档', {NL}, {NL}, '## 一、快速开始', {NL}, {NL}, '请参考各接口的请求示例进行调用。', {NL}, {NL}, {NL}, {NL}, '## 二、接口详情', {NL})
    UNION ALL SELECT repo, 'api_usage_doc', concat('1', grp), part, CASE WHEN part = 0 THEN concat(heading, {NL}, text) ELSE text END FROM ({_RUN_GROUPED}) p JOIN ({_RUN_HEADINGS}) h USING (repo, grp)
    UNION ALL SELECT 'r0', 'api_usage_doc', '2', 0, concat({NL}, {NL}, '## 三、错误处理', {NL}, {NL}, '请参考各接口文档中的错误响应说明。', {NL}, {_FOOT})"""
_DIR_SUMMARY = "concat('[模拟总结] 目录: ', {nm}, chr(10), '子文档数: ', 2 * (k.file_count + k.dir_count) - 1)"


def _side_documents(side: str) -> str:
    return f"""SELECT repo, relative_path, 'file' AS node_type, name, array_to_string(parts[1:len(parts) - 1], '/') AS parent_path, md5(content) AS made, {_FILE_DOC} AS doc FROM {{{side}_kept}}
        UNION ALL SELECT n.repo, n.relative_path, 'directory', n.name, n.parent_path, NULL, {_dir_doc(_DIR_SUMMARY)} FROM {{{side}_nodes}} n JOIN {{{side}_kids}} k USING (repo, relative_path) WHERE node_type = 'directory'"""


def _side_made(side: str) -> str:
    """What every document is made from: a file's text, a directory's documents."""
    return f"""SELECT d.*, coalesce(d.made, c.told) AS source FROM ({_side_documents(side)}) d LEFT JOIN (
        SELECT repo, parent_path AS up, md5(string_agg(concat(name, chr(1), node_type, chr(1), doc), chr(2) ORDER BY name, node_type)) AS told
        FROM ({_side_documents(side)}) x WHERE relative_path <> '' GROUP BY ALL) c ON c.repo = d.repo AND c.up = d.relative_path AND d.node_type = 'directory'"""


def _ring(edges: str) -> str:
    """Components of ``e(repo, s, t)``, and of each the first in order of its shortest cycles through its smallest node."""
    return f"""WITH RECURSIVE {edges}, w AS (SELECT repo, s, t FROM e UNION SELECT w.repo, w.s, e.t FROM w JOIN e ON e.repo = w.repo AND e.s = w.t),
        c AS (SELECT a.repo, a.s AS node, min(a.t) AS component FROM w a JOIN w b ON a.repo = b.repo AND a.s = b.t AND a.t = b.s GROUP BY ALL),
        i AS (SELECT e.repo, x.component, e.s, e.t FROM e JOIN c x ON x.repo = e.repo AND x.node = e.s JOIN c y ON y.repo = e.repo AND y.node = e.t AND y.component = x.component),
        p AS (SELECT DISTINCT repo, component, component AS node, [component] AS path FROM c
          UNION ALL SELECT p.repo, p.component, i.t, list_append(p.path, i.t) FROM p JOIN i ON i.repo = p.repo AND i.component = p.component AND i.s = p.node
            WHERE (len(p.path) = 1 OR p.node <> p.component) AND (i.t = p.component OR NOT list_contains(p.path, i.t))),
        b AS (SELECT repo, component, path FROM p WHERE node = component AND len(path) > 1 QUALIFY row_number() OVER (PARTITION BY repo, component ORDER BY len(path), path) = 1)
        SELECT repo, component, CAST(len(path) - 1 AS BIGINT) AS length, unnest(path) AS node, CAST(generate_subscripts(path, 1) - 1 AS BIGINT) AS position FROM b"""


_CODE_AND_RINGS = """e AS (SELECT DISTINCT repo, source AS s, resolved AS t FROM {resolved} WHERE resolved IS NOT NULL
        UNION SELECT concat('r', doc_id % 4), concat('ring/', doc_id % 37 + 3, '/', doc_id % 7), concat('ring/', doc_id % 37 + 3, '/', (doc_id + 1) % 7) FROM documents)"""
_ONE_RING = """e AS (SELECT 'r' AS repo, concat('d', doc_id) AS s, concat('d', CASE WHEN doc_id = (SELECT max(doc_id) FROM documents) THEN (SELECT min(doc_id) FROM documents) ELSE doc_id + 1 END) AS t FROM documents
        UNION SELECT 'r', 'hub', CASE WHEN doc_id % 3 = 0 THEN concat('d', doc_id) ELSE 'spoke' END FROM documents UNION SELECT 'r', 'spoke', 'hub')"""

_RECOVERED = """SELECT repo, CASE WHEN doc_path LIKE '%/_dir_summary.md' ESCAPE '#' AND ends_with(doc_path, '/_dir_summary.md') THEN 'directory' ELSE 'file' END AS node_type,
        CASE WHEN ends_with(doc_path, '/_dir_summary.md') THEN substr(replace(doc_path, '/_dir_summary.md', ''), 6) ELSE substr(doc_path, 6, length(doc_path) - 8) END AS relative_path,
        doc_path FROM {docs} WHERE doc_path NOT IN ('docs/README.md', 'docs/API_DOC.md', 'docs/API_USAGE.md')"""

BODIES: dict[str, str] = {
    # predicates
    "ignored_paths": "SELECT repo, relative_path FROM {judged} WHERE ignored",
    "kept_files": "SELECT repo, relative_path, size FROM {kept} WHERE size <= 4096",
    "path_columns": "SELECT repo, relative_path, name, array_to_string(parts[1:len(parts) - 1], '/') AS parent_path, CAST(len(parts) AS INTEGER) AS depth, ext FROM {split_files}",
    "nodes_by_type": "SELECT repo, relative_path, parent_path, name, depth FROM {nodes} WHERE node_type = 'directory'",
    "nodes_at_depth": "SELECT repo, relative_path FROM {nodes} WHERE node_type = 'directory' AND depth = 3",
    "nodes_per_depth": "SELECT repo, depth, node_type, count(*) AS n FROM {nodes} GROUP BY ALL",
    "pending_nodes": "SELECT repo, relative_path, node_type FROM {restored} WHERE status = 'pending'",
    "api_nodes": "SELECT repo, relative_path, api_info FROM {restored} WHERE node_type = 'file' AND has_api",
    "tasks_by_status": f"SELECT task_id, status FROM ({_LIFE}) l WHERE status = 'completed'",
    "edge_display": "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY source, target, dep_type) AS position, source, target, dep_type FROM {edges} WHERE starts_with(target, '.') OR contains(target, '/')",
    "edges_by_form": "SELECT repo, target, count(*) AS n FROM {edges} WHERE NOT (starts_with(target, '.') OR contains(target, '/')) GROUP BY ALL",
    "document_paths": "SELECT repo, relative_path, node_type, doc_path FROM {nodes}",
    "without_own_output": """SELECT f.repo, relative_path FROM {files} f JOIN (SELECT repo, max(lang) AS d FROM {files} GROUP BY repo) o USING (repo)
        WHERE NOT contains(concat('/', relative_path), concat('/', d, '/'))""",
    "stored_lookup": "SELECT f.repo, f.relative_path AS path, a.value FROM {files} f LEFT JOIN {api_list} a USING (repo, relative_path)",
    # hierarchy
    "path_ancestors": """SELECT repo, d AS ancestor, count(*) AS n FROM (SELECT repo,
        unnest(list_transform(range(0, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS d FROM {split_files}) x GROUP BY ALL""",
    "pruned_directories": "SELECT repo, relative_path FROM {all_dirs} WHERE relative_path = '' OR (repo, relative_path) IN (SELECT (repo, relative_path) FROM {dirs})",
    "pruned_counts": "SELECT repo, count(*) AS pruned FROM {all_dirs} WHERE relative_path <> '' AND (repo, relative_path) NOT IN (SELECT (repo, relative_path) FROM {dirs}) GROUP BY repo",
    "max_depths": "SELECT repo, max(depth) AS max_depth FROM {nodes} GROUP BY repo",
    "child_counts": "SELECT n.repo, n.relative_path, coalesce(file_count, 0) AS file_count, coalesce(dir_count, 0) AS dir_count FROM {nodes} n LEFT JOIN {kids} USING (repo, relative_path) WHERE node_type = 'directory'",
    "tree_totals": "SELECT repo, count(*) FILTER (node_type = 'file') AS total_files, count(*) FILTER (node_type = 'directory') AS total_dirs, max(depth) AS max_depth FROM {nodes} GROUP BY repo",
    "subtree_totals": """SELECT repo, d AS relative_path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM (SELECT repo, size,
        unnest(list_transform(range(0, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS d FROM {kept}) x GROUP BY ALL""",
    "sibling_order": "SELECT repo, parent_path, relative_path, row_number() OVER (PARTITION BY repo, parent_path ORDER BY node_type = 'file', lower(name), name) AS sibling_rank FROM {nodes} WHERE relative_path <> ''",
    "tree_listing": _LIST,
    "tree_listing_dirs": _LIST,
    "bottom_up_fold": f"""SELECT repo, relative_path, 'file' AS node_type, 'completed' AS status, {_FILE_DOC} AS content FROM {{kept}}
        UNION ALL SELECT n.repo, n.relative_path, 'directory', 'completed', {_dir_doc("concat('[模拟总结] 目录: ', {nm}, chr(10), '子文档数: ', 2 * (k.file_count + k.dir_count) - 1)")}
        FROM {{nodes}} n JOIN {{kids}} k USING (repo, relative_path) WHERE node_type = 'directory'""",
    "child_documents": _parts("(SELECT repo, array_to_string(parts[1:len(parts) - 1], '/') AS dir, name, content FROM {kept})", "repo, dir", "lower(name), name", f"concat('### ', name, {NL}, {NL}, md5(content))", _SEP, 16),
    "all_file_documents": "SELECT repo, part, md5(text) AS digest, n_rows FROM (" + _parts("(SELECT t.*, k.content FROM {tokens} t JOIN {kept} k USING (repo, relative_path) WHERE node_type = 'file')", "repo", "preorder", f"concat('### ', relative_path, {NL}, {NL}, content)", _SEP, 64) + ") p",
    "display_names": """SELECT repo, relative_path, CASE WHEN starts_with(lower(name), 'config_') THEN concat(name, ' [配置]')
        WHEN regexp_matches(lower(name), '_utils(\\.[a-z]+)?$') THEN concat(name, ' [工具函数]') ELSE name END AS label FROM {files}""",
    # snapshots and state
    "fingerprints": "SELECT repo, relative_path AS path, size, mtime, md5(content) AS content_hash FROM {files}",
    "snapshot_changes": "SELECT repo, path, change_type, old_hash, new_hash FROM {changes}",
    "affected_nodes": "SELECT repo, node_type, relative_path FROM {affected}",
    "affected_summary": "SELECT repo, count(*) FILTER (node_type = 'file') AS affected_files, count(*) FILTER (node_type = 'directory') AS affected_dirs FROM {affected} GROUP BY repo",
    "marked_nodes": "SELECT repo, relative_path, node_type, status FROM {remarked}",
    "marked_counts": "SELECT repo, count(*) FILTER (status = 'pending') AS marked FROM {remarked} GROUP BY repo",
    "upserted_fingerprints": """SELECT n.repo, n.relative_path AS path, CASE WHEN c.repo IS NULL THEN o.size ELSE n.size END AS size, n.mtime, md5(n.content) AS content_hash,
        c.repo IS NOT NULL AS analyzed FROM {files_new} n LEFT JOIN {files_old} o USING (repo, relative_path) LEFT JOIN {changes} c ON c.repo = n.repo AND c.path = n.relative_path""",
    "rerun_documents": f"""SELECT n.repo, n.relative_path, n.node_type, 'completed' AS status, md5(n.doc) AS digest, o.repo IS NULL AS folded
        FROM ({_side_made('new')}) n LEFT JOIN ({_side_made('old')}) o ON o.repo = n.repo AND o.relative_path = n.relative_path AND o.node_type = n.node_type AND o.source = n.source""",
    "failed_with_error": """SELECT r.repo, r.relative_path, r.node_type, e.value AS error FROM {records} r LEFT JOIN (
        SELECT repo, key AS relative_path, arg_max(value, seq) AS value FROM {error_log} GROUP BY ALL) e USING (repo, relative_path) WHERE r.failed""",
    "change_counts": """SELECT repo, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'modified') AS modified,
        count(*) FILTER (change_type = 'deleted') AS deleted, count(*) AS total FROM {changes} GROUP BY repo""",
    "missing_nodes": "SELECT repo, relative_path, node_type FROM {nodes} n WHERE NOT EXISTS (SELECT 1 FROM {docs} d WHERE d.repo = n.repo AND d.doc_path = n.doc_path)",
    "completed_nodes": "SELECT repo, relative_path, node_type FROM {restored} WHERE status = 'completed'",
    "restored_status": "SELECT repo, relative_path, status, doc_path, has_api, api_info FROM {restored}",
    "restored_counts": "SELECT repo, count(*) FILTER (status = 'completed') AS restored FROM {restored} GROUP BY repo",
    "state_transitions": "SELECT repo, node_type, relative_path, completed, failed, status FROM {records}",
    "current_state": "SELECT repo, kind, key, value, seq FROM {latest}",
    "invalidated_repos": """SELECT repo, count(*) AS new_api_files FROM {judged_blocks} b WHERE has_api
        AND NOT EXISTS (SELECT 1 FROM {details} d WHERE d.repo = b.repo AND d.source_file = b.relative_path) GROUP BY repo""",
    "document_gate": """SELECT r.repo, coalesce(l.value = 'true', false) AND EXISTS (SELECT 1 FROM {docs} d WHERE d.repo = r.repo AND d.doc_path = 'docs/API_DOC.md')
        AND NOT EXISTS (SELECT 1 FROM {api_list} a WHERE a.repo = r.repo AND NOT EXISTS (SELECT 1 FROM {detail_list} t WHERE t.repo = a.repo AND t.relative_path = a.relative_path)) AS completed
        FROM (SELECT DISTINCT repo FROM {state_log}) r LEFT JOIN {latest} l ON l.repo = r.repo AND l.kind = 'flag' AND l.key = 'api_doc'""",
    "missing_details": "SELECT repo, relative_path FROM {api_list} WHERE (repo, relative_path) NOT IN (SELECT (repo, relative_path) FROM {detail_list})",
    "details_progress": "SELECT a.repo, count(d.value) AS done, count(*) AS total FROM {api_list} a LEFT JOIN {detail_list} d USING (repo, relative_path) GROUP BY a.repo",
    "split_completed": "SELECT repo, relative_path, status = 'completed' AS success FROM {restored} WHERE node_type = 'file'",
    "final_document_flags": """SELECT repo, key, bool_or(flagged) AS flagged, bool_or(present) AS present, bool_or(flagged) AND bool_or(present) AS usable FROM (
        SELECT repo, key, value = 'true' AS flagged, false AS present FROM {latest} WHERE kind = 'flag'
        UNION ALL SELECT repo, CASE doc_path WHEN 'docs/README.md' THEN 'readme' WHEN 'docs/API_DOC.md' THEN 'api_doc' ELSE 'api_usage_doc' END, false, true
        FROM {docs} WHERE doc_path IN ('docs/README.md', 'docs/API_DOC.md', 'docs/API_USAGE.md')) x GROUP BY ALL""",
    "stored_details": "SELECT repo, relative_path AS key, value FROM {detail_list}",
    "recovered_from_documents": _RECOVERED,
    "recovered_log": f"""SELECT DISTINCT repo, node_type AS kind, relative_path AS key, md5('completed') AS value, 1 AS seq FROM (
          SELECT repo, 'file' AS node_type, relative_path FROM {{source_docs}} UNION ALL SELECT repo, node_type, relative_path FROM ({_RECOVERED}) d) x
        UNION ALL SELECT DISTINCT repo, 'flag', CASE doc_path WHEN 'docs/README.md' THEN 'readme' WHEN 'docs/API_DOC.md' THEN 'api_doc' ELSE 'api_usage_doc' END, md5('true'), 1
          FROM {{docs}} WHERE doc_path IN ('docs/README.md', 'docs/API_DOC.md', 'docs/API_USAGE.md')
        UNION ALL SELECT repo, 'api_info', relative_path, md5(block), 1 FROM {{judged_blocks}} WHERE has_api AND block <> ''""",
    "status_report": """SELECT repo, count(*) FILTER (node_type = 'file' AND completed) AS completed_files, count(*) FILTER (node_type = 'directory' AND completed) AS completed_dirs,
        count(*) FILTER (failed) AS failed FROM {records} GROUP BY repo""",
    "first_failed": "SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY relative_path, node_type) AS position, relative_path FROM {records} WHERE failed",
    # graph
    **{f"imports_{k}": sql.replace("FROM code", "FROM {code}") for k, sql in IMPORTS.items()},
    "dependency_edges": "SELECT repo, source, target, dep_type FROM {edges}",
    "graph_nodes": "SELECT repo, node FROM {edge_nodes}",
    "page_graph_nodes": "SELECT repo, node FROM {link_nodes}",
    "resolved_edges": "SELECT repo, source, target, dep_type, resolved FROM {resolved}",
    "out_degrees": "SELECT repo, source AS node, count(*) AS n_out FROM {links} GROUP BY ALL",
    "in_degrees": "SELECT repo, target AS node, count(*) AS n_in FROM {links} GROUP BY ALL",
    "dependencies_of": "SELECT repo, target FROM {edges} WHERE source = 'b0/m0.py'",
    "dependents_of": "SELECT repo, source FROM {edges} WHERE target = 'os'",
    "import_histogram": "SELECT repo, split_part(split_part(target, '.', 1), '/', 1) AS module, count(*) AS n FROM {edges} GROUP BY ALL",
    "top_imports": """SELECT repo, module, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY n DESC, module) AS INTEGER) AS rank FROM (
        SELECT repo, split_part(split_part(target, '.', 1), '/', 1) AS module, count(*) AS n FROM {edges} GROUP BY ALL) h) r WHERE rank <= 10""",
    "cyclic_components": """WITH RECURSIVE e AS (SELECT DISTINCT repo, source AS s, resolved AS t FROM {resolved} WHERE resolved IS NOT NULL
        UNION SELECT concat('r', doc_id % 4), concat('ring/', doc_id % 37 + 3, '/', doc_id % 7), concat('ring/', doc_id % 37 + 3, '/', (doc_id + 1) % 7) FROM documents),
        w AS (SELECT repo, s, t FROM e UNION SELECT w.repo, w.s, e.t FROM w JOIN e ON e.repo = w.repo AND e.s = w.t),
        c AS (SELECT a.repo, a.s AS node, min(a.t) AS component, count(DISTINCT a.t) AS size FROM w a JOIN w b ON a.repo = b.repo AND a.s = b.t AND a.t = b.s GROUP BY ALL)
        SELECT repo, component, size, node FROM c""",
    "component_cycles": _ring(_CODE_AND_RINGS),
    "ring_cycles": _ring(_ONE_RING),
    "dependency_cycles": """WITH e AS (SELECT DISTINCT repo, source AS s, resolved AS t FROM {resolved} WHERE resolved IS NOT NULL)
        SELECT repo, 1 AS length, concat(s, ' -> ', t) AS cycle FROM e WHERE s = t
        UNION ALL SELECT a.repo, 2, concat(a.s, ' -> ', a.t, ' -> ', a.s) FROM e a JOIN e b ON a.repo = b.repo AND a.t = b.s AND b.t = a.s WHERE a.s < a.t
        UNION ALL SELECT a.repo, 3, concat(a.s, ' -> ', a.t, ' -> ', b.t, ' -> ', a.s) FROM e a JOIN e b ON a.repo = b.repo AND a.t = b.s
          JOIN e c ON c.repo = b.repo AND c.s = b.t AND c.t = a.s WHERE a.s < a.t AND a.s < b.t AND a.t <> b.t""",
    "graph_totals": """SELECT n.repo, n.n_nodes, e.n_edges, e.n_external FROM (SELECT repo, count(*) AS n_nodes FROM {edge_nodes} GROUP BY repo) n
        JOIN (SELECT repo, count(*) AS n_edges, count(DISTINCT CASE WHEN resolved IS NULL THEN split_part(split_part(target, '.', 1), '/', 1) END) AS n_external FROM {resolved} GROUP BY repo) e USING (repo)""",
    "numbered_nodes": r"""SELECT repo, node, concat('N', row_number() OVER (PARTITION BY repo ORDER BY node) - 1) AS node_id,
        CASE WHEN regexp_extract(node, '([^/\\]*)$', 1) = '' THEN node ELSE regexp_extract(node, '([^/\\]*)$', 1) END AS label FROM {link_nodes}""",
    "numbered_edges": """SELECT e.repo, concat('    N', a.n, ' --> N', b.n) AS line FROM {edges} e
        JOIN (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY node) - 1 AS n FROM {edge_nodes}) a ON a.repo = e.repo AND a.node = e.source
        JOIN (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY node) - 1 AS n FROM {edge_nodes}) b ON b.repo = e.repo AND b.node = e.target""",
    "node_export": "SELECT repo, CAST(json_object('node', node) AS STRING) AS json FROM {edge_nodes}",
    "edge_export": "SELECT repo, CAST(json_object('source', source, 'target', target, 'type', dep_type, 'line', NULL, 'detail', detail) AS STRING) AS json FROM {edges}",
    # endpoints
    "api_blocks": "SELECT repo, relative_path, has_api, CASE WHEN has_api THEN block END AS api_info FROM {judged_blocks}",
    "endpoint_rows": 'SELECT repo, source_file, CAST(pos AS INTEGER) AS pos, module, method, path, "desc" FROM {apis}',
    "module_names": f"SELECT module, {_BADGE} AS label, count(*) AS n FROM {{apis}} GROUP BY ALL",
    "overview_table": f"""SELECT repo, n AS ordinal, concat('| ', n, ' | ', {_BADGE}, ' | ', method, ' | ', path, ' | ', "desc", ' | 否 |') AS line
        FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY source_file, pos) AS n FROM {{apis}}) x""",
    "overview_frame": "SELECT repo, count(*) AS total, concat('**接口总计：', count(*), ' 个**') AS foot FROM {apis} GROUP BY repo",
    "overview_endpoints": "SELECT repo, doc, api FROM {overview}",
    "usage_endpoints": "SELECT repo, doc, origin, api FROM {usage}",
    "endpoints_by_module": "SELECT repo, doc, module, api FROM {modules}",
    "normalised_endpoints": f"SELECT repo, {_KEY} AS key, count(*) AS n FROM (SELECT repo, concat(method, ' ', path) AS api FROM {{apis}}) a GROUP BY ALL",
    "endpoint_multiset_difference": _gaps("repo"),
    "endpoint_consistency": f"""SELECT s.repo, s.doc, s.n_overview, s.n_usage, coalesce(g.missing, 0) AS missing, coalesce(g.extra, 0) AS extra, g.repo IS NULL AS consistent FROM (
        SELECT repo, doc, count(*) FILTER (w = 1) AS n_overview, count(*) FILTER (w = 2) AS n_usage FROM (
          SELECT repo, doc, 1 AS w FROM {{overview}} UNION ALL SELECT repo, doc, 2 FROM {{usage}}) x GROUP BY ALL) s
        LEFT JOIN (SELECT repo, doc, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(extra) AS BIGINT) AS extra FROM ({_gaps("repo, doc")}) y GROUP BY ALL) g USING (repo, doc)""",
    "endpoint_set_difference": """SELECT *, 'left' AS side FROM (SELECT repo, upper(api) AS key FROM {overview} EXCEPT SELECT repo, upper(api) FROM {usage}) a
        UNION ALL SELECT *, 'right' FROM (SELECT repo, upper(api) FROM {usage} EXCEPT SELECT repo, upper(api) FROM {overview}) b""",
    "heading_endpoints": "SELECT repo, doc, api FROM {heading_apis}",
    "missing_by_file": "SELECT repo, source_file, concat(method, ' ', path) AS api FROM {apis} a WHERE NOT EXISTS (SELECT 1 FROM {heading_apis} h WHERE h.repo = a.repo AND h.api = concat(a.method, ' ', a.path))",
    "extra_endpoints": "SELECT repo, api FROM {heading_apis} EXCEPT SELECT repo, concat(method, ' ', path) FROM {apis}",
    "files_without_details": "SELECT repo, source_file FROM {api_info} a WHERE NOT EXISTS (SELECT 1 FROM {details} d WHERE d.repo = a.repo AND d.source_file = a.source_file)",
    "endpoint_coverage": """SELECT repo, source_file, CAST(count(*) FILTER (hit) AS INTEGER) AS covered, CAST(count(*) AS INTEGER) AS total,
        coalesce(string_agg(concat(method, ' ', path), '; ' ORDER BY pos) FILTER (NOT hit), '') AS missed FROM (
          SELECT a.*, contains(coalesce(d.details, ''), a.path) AS hit FROM {apis} a LEFT JOIN {details} d USING (repo, source_file)) x GROUP BY ALL""",
    "grouped_details": f"SELECT repo, grp, heading, part, text, n_rows FROM ({_GROUPED}) p JOIN ({_HEADINGS}) h USING (repo, grp)",
    "document_sections": f"SELECT repo, doc, {_QUICK} AS quick, {_TAIL} AS tail, {_MERGED} AS merged, {_MODULES} AS modules FROM {_MARKS}",
    "endpoint_totals": "SELECT source_file AS repo, count(*) AS total FROM {apis} GROUP BY source_file",
    "merged_modules": f"""SELECT repo, n, module, concat({NL}, '### 2.', n, ' ', module, {NL}, {NL}, content) AS text FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY
        coalesce(list_position(['核心业务接口', '会话管理接口', '资源管理接口', '用户与认证接口', '系统管理接口', '辅助接口'], module), 9), module) AS n FROM {{module_docs}}) x""",
    "module_overview_counts": """SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY coalesce(list_position(['核心业务接口', '会话管理接口', '资源管理接口', '用户与认证接口', '系统管理接口', '辅助接口'], module), 9), module) AS n,
        module, total, concat('- ', module, ': ', total, ' 个') AS line FROM (SELECT repo, module, count(*) AS total FROM {modules} GROUP BY repo, module) t""",
    "numbered_endpoint_list": "SELECT repo, doc, CAST((n - 1) // 32 AS BIGINT) AS part, string_agg(concat(n, '. ', api), chr(10) ORDER BY n) AS text, count(*) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY repo, doc ORDER BY pos) AS n FROM {overview}) x GROUP BY repo, doc, (n - 1) // 32",
    "combined_details": _parts("{details}", "repo", "source_file", f"concat('## 文件: ', source_file, {NL}, {NL}, details)", _SEP, 32),
    # documents
    "file_documents": f"SELECT repo, concat('docs/', relative_path, '.md') AS doc_path, {_FILE_DOC} AS content FROM {{kept}}",
    "directory_documents": f"SELECT n.repo, n.doc_path, {_dir_doc(chr(39) + 's' + chr(39))} AS content FROM {{nodes}} n JOIN {{kids}} k USING (repo, relative_path) WHERE node_type = 'directory'",
    "project_documents": f"""SELECT repo, doc, concat(CASE WHEN ends_with(doc, '1') THEN concat('# ', repo, ' - 文档阅读顺序指南', {NL}, {NL}, '> 本指南帮助你按照合理的顺序阅读项目文档，快速理解项目结构和核心逻辑。', {NL}, {NL}, '---', {NL}, {NL})
        WHEN ends_with(doc, '2') THEN concat('# ', repo, ' - API接口清单', {NL}, {NL}, '> 本文档列出项目的所有API接口及其功能描述。', {NL}, '> 注意：本文档仅包含接口清单，不包含详细的请求/响应示例。', {NL}, {NL}, '---', {NL}, {NL}) ELSE '' END,
        content, {NL}, {NL}, '---', {NL}, {NL}, '*本文档由 grovelark 自动生成*', {NL}, '*生成时间: {STAMP}*', {NL}) AS content FROM {{common_docs}}""",
    "read_document": "SELECT n.repo, n.relative_path, md5(d.content) AS digest FROM {nodes} n JOIN {docs} d USING (repo, doc_path)",
    "assembled_api_documents": f"""SELECT repo, doc, concat('# ', repo, ' API接口文档', {NL}, {NL}, 'table of ', doc, {NL}, CASE WHEN modules IS NULL THEN concat({NL}, content) ELSE modules END) AS content
        FROM (SELECT *, {_MODULES} AS modules FROM {{common_docs}}) x""",
    "api_document_parts": f"""SELECT repo, '' AS block, 0 AS part, concat('# ', repo, ' API使用文档', {NL}, {NL}, '## 一、快速开始', {NL}, {NL}, '请参考各接口的请求示例进行调用。', {NL}, {NL}, {NL}, {NL}, '## 二、接口详情', {NL}) AS text FROM (SELECT DISTINCT repo FROM {{api_info}}) r
        UNION ALL SELECT repo, concat('1', grp), part, CASE WHEN part = 0 THEN concat(heading, {NL}, text) ELSE text END FROM ({_GROUPED}) p JOIN ({_HEADINGS}) h USING (repo, grp)
        UNION ALL SELECT DISTINCT repo, '2', 0, concat({NL}, {NL}, '## 三、错误处理', {NL}, {NL}, '请参考各接口文档中的错误响应说明。', {NL}) FROM {{api_info}}""",
    "analysed_documents": f"""SELECT 'part' AS what, repo, kind, block, CAST(part AS BIGINT) AS part, md5(text) AS value FROM ({_RUN_TEXTS}) t
        UNION ALL SELECT 'gate', repo, kind, NULL, CASE WHEN repo = 'r1' AND kind = 'api_usage_doc' THEN (SELECT count(*) FROM {{run_api}} WHERE repo = 'r1' AND ends_with(source_file, '7.py')) ELSE 0 END,
          CASE WHEN repo = 'r2' THEN 'stopped' WHEN repo = 'r1' AND kind = 'readme' THEN 'kept' WHEN repo = 'r1' AND kind = 'api_usage_doc' THEN 'details missing' ELSE 'written' END
          FROM (SELECT DISTINCT repo FROM {{source_docs}}) r, (SELECT unnest(['readme', 'reading_guide', 'api_doc', 'api_usage_doc']) AS kind) k
        UNION ALL SELECT 'check', 'r0', NULL, NULL, NULL, concat_ws(' ', listed, used, listed, used, 'false') FROM (
          SELECT (SELECT count(*) FROM {{run_apis}} WHERE repo = 'r0') AS listed,
                 count(*) + max(starts_with(source_file, 'data-hub/')::INT) AS used FROM {{run_usage}}) x  -- by the grammar the heading "2.n Data Hub…" names one too
        UNION ALL SELECT 'failed', 'r2', 'file', 'voice/f2.py', NULL, 'refused'""",
    # enrichment
    "text_function": "SELECT repo, relative_path, NOT ends_with(relative_path, '7.py') AS success, CASE WHEN NOT ends_with(relative_path, '7.py') THEN concat(md5(content), ' ', relative_path) END AS summary, CASE WHEN ends_with(relative_path, '7.py') THEN 'refused' END AS error FROM {kept}",
    "retried_text_function": "SELECT repo, relative_path, CASE WHEN ends_with(relative_path, '7.py') THEN 2 ELSE 0 END AS attempt, NOT ends_with(relative_path, '7.py') AS success, CASE WHEN NOT ends_with(relative_path, '7.py') THEN concat(md5(content), ' ', relative_path) END AS summary, CASE WHEN ends_with(relative_path, '7.py') THEN 'refused' END AS error FROM {kept}",
    "ledgered_text_function": """SELECT repo, relative_path, CASE WHEN bad THEN 2 ELSE 0 END AS attempt, NOT bad AS success, CASE WHEN NOT bad THEN d END AS summary,
        CASE WHEN bad THEN 'blank output' END AS error, CASE WHEN bad THEN 3 ELSE 1 END AS calls FROM (SELECT *, md5(content) AS d, left(md5(content), 1) IN ('0', '1') AS bad FROM {kept}) k""",
    "standin_summaries": f"SELECT repo, relative_path, {_STANDIN} AS summary FROM {{kept}}",
    "standin_projects": f"SELECT repo, concat('# ', repo, {NL}, {NL}, '[模拟README]', {NL}, {NL}, '路径: ', min(relative_path)) AS summary FROM {{files}} GROUP BY repo",
    "filled_prompts": f"SELECT conv_id, turn, md5(concat('[', role, '] ', text, {NL}, '(', role, ', ', turn, ')')) AS digest FROM {{conversations}}",
    "validated_outputs": "SELECT conv_id, turn, NOT bad AS success, CASE WHEN NOT bad THEN role END AS summary, CASE WHEN bad THEN 'blank output' END AS error FROM (SELECT *, turn % 3 = 0 OR turn % 5 = 4 AS bad FROM {conversations}) x",
    "retry_delays": "SELECT conv_id, turn, least(CAST(power(2, turn) AS DOUBLE), 60.0) AS delay FROM {conversations}",
    "split_outcomes": f"SELECT task_id, type = 'analysis_file_complete' AS success, count(*) AS n, max(current) AS longest FROM {{progress}} WHERE {_FILE_DONE} GROUP BY ALL",
    "chunk_totals": "SELECT request_id, arg_max(finish_reason, seq) FILTER (finish_reason <> '') AS finish_reason, count(*) AS chunk_count FROM {chunks} GROUP BY request_id",
    "collected_text": _parts("""(SELECT request_id, seq, 'content' AS kind, content AS body FROM {chunks} WHERE content <> ''
        UNION ALL SELECT request_id, seq, 'reasoning', reasoning_content FROM {chunks} WHERE reasoning_content <> '')""", "request_id, kind", "seq", "body", "''", 4),
    "decoded_event_lines": """WITH d AS (SELECT request_id, seq, substr(line, 7) AS body FROM {event_lines} WHERE starts_with(line, 'data: ')),
        j AS (SELECT request_id, seq, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS e FROM d
              WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.request_id = d.request_id AND x.body = '[DONE]' AND x.seq <= d.seq)),
        c AS (SELECT request_id, seq, CASE WHEN e->>'$.type' = 'content_block_delta' AND e->>'$.delta.type' = 'text_delta' THEN nullif(e->>'$.delta.text', '') END AS content,
              CASE WHEN e->>'$.type' = 'message_delta' THEN nullif(e->>'$.delta.stop_reason', '') WHEN e->>'$.type' = 'message_stop' THEN 'stop' END AS finish_reason FROM j)
        SELECT * FROM c WHERE content IS NOT NULL OR finish_reason IS NOT NULL""",
    "system_messages": "SELECT conv_id, text AS system FROM {conversations} WHERE role = 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "ordered_messages": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, text AS content FROM {conversations} WHERE role <> 'system'",
    "extracted_api_details": "SELECT repo, relative_path AS source_file, block AS api_info FROM {judged_blocks} b WHERE has_api AND NOT EXISTS (SELECT 1 FROM {details} d WHERE d.repo = b.repo AND d.source_file = b.relative_path)",
    "project_inputs": "SELECT repo, 'children' AS kind, part, text FROM (" + _parts("(SELECT repo, name, content FROM {kept} WHERE len(parts) = 1)", "repo", "lower(name), name", f"concat('### ', name, {NL}, {NL}, md5(content))", _SEP, 32)
    + ") c UNION ALL SELECT repo, 'structure', part, text FROM (" + _parts("{listing}", "repo", "preorder", "line", NL, 32) + ") s",
    # scalars and reports
    "repaired_urls": r"""SELECT page_id, CASE WHEN regexp_matches(regexp_replace(c, 'https?://', ''), '//') THEN replace(replace(replace(c, '//v1', '/v1'), '//messages', '/messages'), '//chat', '/chat') ELSE c END AS url
        FROM (SELECT page_id, rtrim(concat(regexp_replace(url, '/(en|fr)/', '//v1/', 'g'), CASE WHEN page_id % 3 = 0 THEN '//' ELSE '' END), '/') AS c FROM {pages}) x""",
    "percentages": f"SELECT seq, {_PCT} AS pct, least(100.0, {_PCT}) AS capped FROM {{progress}}",
    "last_segments": r"SELECT page_id, CASE WHEN regexp_extract(url, '([^/\\]*)$', 1) = '' THEN url ELSE regexp_extract(url, '([^/\\]*)$', 1) END AS tail FROM {pages}",
    "extension_histogram": "SELECT CASE WHEN ext = '' THEN '(无扩展名)' ELSE ext END AS ext, count(*) AS n FROM {split_files} GROUP BY ALL",
    "queue_stats": f"""SELECT task_id, count(*) AS total, count(*) FILTER (s = 'queued') AS queued, CAST(0 AS BIGINT) AS running, count(*) FILTER (s = 'completed') AS completed,
        count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'queued') AS pending FROM (
          SELECT task_id, CASE WHEN length(file_path) % 2 = 0 THEN 'queued' ELSE status END AS s FROM ({_NODE_STATUS}) a) b GROUP BY task_id""",
    "run_stats": """SELECT repo, count(*) FILTER (node_type = 'file') AS total_files, count(*) FILTER (node_type = 'directory') AS total_dirs,
        count(*) FILTER (status = 'completed') AS processed, count(*) FILTER (status = 'failed') AS failed, max(depth) AS max_depth FROM {restored} GROUP BY repo""",
    "run_remaining": "SELECT repo, count(*) FILTER (status = 'pending') AS remaining FROM {restored} GROUP BY repo",
    "run_throughput": """SELECT task_id, completed, failed, elapsed, completed / nullif(elapsed, 0) AS throughput FROM (
        SELECT task_id, count(*) FILTER (type = 'analysis_file_complete') AS completed, count(*) FILTER (type = 'analysis_file_failed') AS failed,
               date_sub('second', min(ts), max(ts)) AS elapsed FROM {progress} GROUP BY task_id) x""",
    "run_elapsed": f"SELECT task_id, status, date_sub('second', started_at, coalesce(completed_at, TIMESTAMP '2024-02-01 00:00:00')) AS elapsed FROM ({_LIFE}) l",
    "level_summary": "SELECT repo, depth, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total FROM {restored} GROUP BY ALL",
    "level_failures": "SELECT repo, depth, relative_path, concat('lost ', name) AS error_message FROM {restored} WHERE status = 'failed'",
    # events
    "task_states": _TASK_STATE,
    "node_statuses": _NODE_STATUS,
    "task_lifecycles": _LIFE,
    "level_counters": _LEVELS,
    "level_progress": f"""SELECT e.task_id, e.depth, count(*) AS level_completed FROM {{ordered}} e
        JOIN (SELECT task_id, depth, max(o) AS since FROM {{ordered}} WHERE type = 'analysis_started' GROUP BY ALL) s ON s.task_id = e.task_id AND s.depth = e.depth
        WHERE {_FILE_DONE} AND e.o > s.since GROUP BY ALL""",
    "active_nodes": f"""SELECT task_id, file_path, date_sub('second', ts, TIMESTAMP '2024-02-01 00:00:00') AS elapsed_seconds FROM (
        SELECT * FROM {{progress}} WHERE type = 'analysis_file_started' OR {_FILE_DONE} QUALIFY row_number() OVER (PARTITION BY task_id, file_path ORDER BY ts DESC, seq DESC) = 1) x
        WHERE type = 'analysis_file_started'""",
    "task_subscription": "SELECT task_id, seq, type FROM {progress} WHERE task_id = 7",
    "event_round_trip": f"""SELECT CAST(task_id AS STRING) AS task_id, type, file_path, CASE WHEN type = 'analysis_file_complete' THEN concat('docs/', file_path, '.md') END AS doc_path,
        CASE WHEN type = 'analysis_file_failed' THEN error END AS error FROM {{progress}} WHERE {_FILE_DONE}""",
    "quarantined_messages": """WITH j AS (SELECT *, CASE WHEN NOT json_valid(value) THEN 'not JSON' WHEN json_type(value) <> 'OBJECT' THEN 'not an object'
          WHEN json_extract_string(value, '$.type') IS NULL THEN 'no type' WHEN json_extract(value, '$.data') IS NULL THEN 'no data' END AS reason FROM {messages})
        SELECT 'read' AS what, json_extract_string(value, '$.type') AS type, count(*) AS n, sum(json_extract(value, '$.data.current')::BIGINT) AS current, NULL AS position, NULL AS raw FROM j WHERE reason IS NULL GROUP BY ALL
        UNION ALL SELECT 'quarantined', reason, 1, NULL, event_id, value FROM j WHERE reason IS NOT NULL""",
    "quarantined_trees": """WITH j AS (SELECT *, CASE WHEN NOT json_valid(json) THEN 'not JSON' WHEN json_extract(json, '$.relative_path') IS NULL THEN 'no relative_path' END AS reason FROM {trees})
        SELECT repo, 'node' AS what, '' AS text, 'directory' AS node_type, 0 AS depth, false AS has_api FROM j WHERE reason IS NULL
        UNION ALL SELECT repo, 'node', json_extract_string(json, '$.children[0].name'), 'file', 1, true FROM j WHERE reason IS NULL
        UNION ALL SELECT repo, reason, json, NULL, NULL, NULL FROM j WHERE reason IS NOT NULL""",
    "message_builders": f"""SELECT CAST(task_id AS STRING) AS task_id, 'analysis_started' AS type, count(*) AS n, NULL AS current, NULL AS total, NULL AS percentage, NULL AS current_file, sum(total) AS total_files, NULL AS completed, NULL AS depth, NULL AS error, NULL AS files FROM {{progress}} GROUP BY ALL
        UNION ALL SELECT CAST(task_id AS STRING), 'analysis_progress', count(*), sum(current), sum(total), max({_PCT}), max(file_path), NULL, NULL, NULL, NULL, NULL FROM {{progress}} GROUP BY ALL
        UNION ALL SELECT CAST(task_id AS STRING), 'analysis_level_complete', count(*), NULL, sum(total), NULL, NULL, NULL, sum(current), max(depth), NULL, NULL FROM {{progress}} GROUP BY ALL
        UNION ALL SELECT CAST(task_id AS STRING), 'analysis_complete', count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, max(CAST(seq AS STRING)) FROM {{progress}} WHERE seq % 2 <> 0 GROUP BY ALL
        UNION ALL SELECT CAST(task_id AS STRING), 'analysis_error', count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, max(error), NULL FROM {{progress}} WHERE seq % 2 = 0 GROUP BY ALL""",
    "streamed_task_states": _TASK_STATE,
    "streamed_node_statuses": _NODE_STATUS,
    "streamed_level_counters": _LEVELS,
    "streamed_changes": "SELECT repo, path, change_type FROM {changes}",
    "streamed_snapshots": """SELECT coalesce(n.snapshot, o.snapshot + 1) AS run, coalesce(n.repo, o.repo) AS repo, coalesce(n.relative_path, o.relative_path) AS path,
          CASE WHEN o.repo IS NULL THEN 'added' WHEN n.repo IS NULL THEN 'deleted' ELSE 'modified' END AS change_type, md5(o.content) AS old_hash, md5(n.content) AS new_hash
        FROM {file_snapshots} n FULL JOIN (SELECT * FROM {file_snapshots} WHERE snapshot < 4) o ON o.snapshot + 1 = n.snapshot AND o.repo = n.repo AND o.relative_path = n.relative_path
        WHERE o.repo IS NULL OR n.repo IS NULL OR md5(o.content) <> md5(n.content)
        UNION ALL SELECT NULL, repo, relative_path, 'state', NULL, md5(content) FROM {file_snapshots} WHERE snapshot = 4""",
}


def _dirs_listing() -> str:
    """The listing over directories of at most two levels."""
    sql = build(_LIST)
    return re.sub(r"(\btokens AS \(.*?FROM )nodes\)", r"\1(SELECT * FROM nodes WHERE node_type = 'directory' AND depth <= 2) nodes)", sql, flags=re.S)


def oracle_sql() -> dict[str, str]:
    out = {name: build(body) for name, body in BODIES.items()}
    out["tree_listing_dirs"] = _dirs_listing()
    return out
