"""Source-like tables derived from plain tables of texts, parts, events and chats.

Each view is one SQL text in the common subset of Spark and ANSI engines, so a
second engine can be given exactly the same input. Tokens in angle brackets
stand for the few spellings that differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

BASE = ("documents", "labels", "part", "events", "conversations", "pages")

# <bytes x> byte length, <div> integer division, <join_lines x | key> ordered
# join of lines, <id> text form of a number, <nl> <q> <dq> <bq> characters
VIEWS: dict[str, str] = {
    "files": """
SELECT doc_id, lang, source, content, size, mtime, repo, name,
       CASE WHEN doc_id % 41 = 0 THEN name
            ELSE concat(head, lang, '/', source, '/d', <id doc_id % 7>, '/', name) END AS relative_path
FROM (
  SELECT doc_id, lang, source, text AS content, CAST(<bytes text> AS BIGINT) AS size, 1704067200 + doc_id AS mtime,
         concat('r', <id doc_id % 4>) AS repo,
         concat(CASE WHEN doc_id % 8 = 3 THEN concat('config_', <id doc_id>)
                     WHEN doc_id % 8 = 5 THEN concat('D', <id doc_id>, '_Utils')
                     ELSE concat('doc_', <id doc_id>) END,
                CASE WHEN doc_id % 37 = 0 THEN '.log' WHEN doc_id % 6 = 0 THEN '.py' WHEN doc_id % 6 = 1 THEN '.js'
                     WHEN doc_id % 6 = 2 THEN '.TS' WHEN doc_id % 6 = 3 THEN '.java' WHEN doc_id % 6 = 4 THEN '.md'
                     ELSE '' END) AS name,
         CASE WHEN doc_id % 17 = 0 THEN '.cache/' WHEN doc_id % 13 = 0 THEN 'node_modules/pkg/'
              WHEN doc_id % 29 = 0 THEN 'lib/dist/'
              WHEN doc_id % 30 = 10 THEN concat('notes/n', <id doc_id>, '/') ELSE '' END AS head
  FROM {documents}) t""",
    "files_old": "SELECT * FROM {files} WHERE doc_id % 10 <> 2",
    "files_new": """
SELECT doc_id, repo, relative_path, name, mtime,
       CASE WHEN doc_id % 10 = 1 THEN size + 1 ELSE size END AS size,
       CASE WHEN doc_id % 10 = 1 THEN concat(content, 'x') ELSE content END AS content
FROM {files} WHERE doc_id % 10 <> 0""",
    "file_snapshots": " UNION ALL ".join(
        f"SELECT CAST({s} AS BIGINT) AS snapshot, repo, relative_path, size, mtime, "
        f"CASE WHEN doc_id % 10 = {s} THEN concat(content, 'v{s}') ELSE content END AS content FROM {{files}} WHERE (doc_id + {s}) % 7 <> 0"
        for s in range(5)
    ),
    "error_log": """
SELECT repo, 'error' AS kind, relative_path AS key, concat('lost ', name) AS value, doc_id * 10 + 1 AS seq
FROM {files} JOIN {labels} USING (doc_id) WHERE toxic = 1""",
    "code": """
SELECT repo, concat('b', b, '/m', <id i>, ext) AS relative_path, concat('m', <id i>, ext) AS name, ext,
       CASE ext
         WHEN '.py' THEN concat('import os', <nl>, 'import b', b, '.m', t, <nl>, 'from typing import List', <nl>, 'class M:', <nl>, '    pass', <nl>)
         WHEN '.js' THEN concat('import x from ', <q>, './m', t, <q>, ';', <nl>, 'import ', <q>, 'side', <q>, <nl>, 'const y = require(', <q>, 'lodash', <q>, ')', <nl>)
         WHEN '.ts' THEN concat('import type { T } from ', <q>, './m', t, <q>, <nl>, 'import { a } from ', <dq>, 'react', <dq>, <nl>)
         WHEN '.java' THEN concat('import java.util.List;', <nl>, 'import static a.B.c;', <nl>, 'import b', b, '.m', t, ';', <nl>,
                                  'class M', <id i>, ' extends Base', t, ' implements Runnable, Comparable {', <nl>, '}', <nl>)
         ELSE concat('package m', <nl>, 'import ', <dq>, 'fmt', <dq>, <nl>, 'import (', <nl>, '  ', <dq>, 'os', <dq>, <nl>, '  ', <dq>, 'b', b, '/m', t, <dq>, <nl>, ')', <nl>)
       END AS content
FROM (
  SELECT p_partkey % 6 AS i, <id p_partkey <div> 6> AS b, concat('r', <id (p_partkey <div> 6) % 3>) AS repo,
         CASE p_partkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '0' WHEN 3 THEN '4' WHEN 4 THEN '3' ELSE '0' END AS t,
         CASE (p_partkey <div> 6) % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.java' ELSE '.go' END AS ext
  FROM {part}) t""",
    "calls": """
SELECT event_id, event_id <div> 16 AS g, event_id <div> 256 AS g2, event_type, user_id,
       CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'DELETE' ELSE 'MCP工具' END AS method,
       CASE WHEN event_id % 11 = 0 THEN concat('/api/user-list', <id user_id % 9>)
            WHEN event_id % 4 = 3 THEN concat('tool_', event_type, '(a: int, b: str)')
            ELSE concat('/api/', event_type, '/', <id user_id % 50>, CASE WHEN event_id % 5 = 0 THEN '/{id}' ELSE '' END) END AS path,
       concat('does ', event_type, ' ', <id event_id>) AS note
FROM {events}""",
    "api_info": """
SELECT concat('r', <id g % 3>) AS repo,
       concat(CASE g % 5 WHEN 0 THEN 'apiserver/' WHEN 1 THEN 'mqtt_tool/sub/' WHEN 2 THEN 'voice/' WHEN 3 THEN 'data-hub/' ELSE '' END,
              'f', <id g>, '.py') AS source_file,
       g, concat('包含API接口: 是', <nl>, '接口列表:', <nl>, <join_lines line | event_id>) AS info_text
FROM (
  SELECT g, event_id,
         CASE WHEN event_id % 10 = 9 THEN concat('remark ', <id event_id>)
              WHEN event_id % 9 = 0 THEN concat('- ', <bq>, '[', method, '] ', path, <bq>, ' → ', note)
              ELSE concat('- [', method, '] ', path, ' - ', note) END AS line
  FROM {calls}) t
GROUP BY g""",
    "source_docs": """
SELECT repo, source_file AS relative_path,
       concat('# notes', <nl>,
              CASE WHEN g % 4 = 0 THEN concat('<!-- API_START -->', <nl>, info_text, <nl>, '<!-- API_END -->', <nl>, 'after')
                   WHEN g % 4 = 1 THEN concat('<!--api_start-->', <nl>, info_text)
                   WHEN g % 4 = 2 THEN concat('<!-- API_START -->', <nl>, '包含API接口：否', <nl>, info_text, <nl>, '<!-- API_END -->')
                   WHEN g % 8 = 3 THEN concat('<!-- API_START --> plain words /V1/ here <!-- API_END -->')
                   ELSE info_text END) AS content
FROM {api_info}""",
    "details": """
SELECT repo, source_file, <join_lines line | event_id> AS details
FROM (
  SELECT concat('r', <id g % 3>) AS repo, event_id,
         concat(CASE g % 5 WHEN 0 THEN 'apiserver/' WHEN 1 THEN 'mqtt_tool/sub/' WHEN 2 THEN 'voice/' WHEN 3 THEN 'data-hub/' ELSE '' END,
                'f', <id g>, '.py') AS source_file,
         concat('uses ', path, ' to ', note) AS line
  FROM {calls} WHERE g % 5 <> 1 AND event_id % 6 <> 0) t
GROUP BY repo, source_file""",
    "overview_docs": """
SELECT concat('r', <id g2 % 3>) AS repo, concat('d', <id g2>) AS doc,
       concat('# list', <nl>, <nl>, '| 序号 | 模块 | 方法 | 路径 | 说明 |', <nl>, '|------|------|------|------|------|', <nl>,
              <join_lines line | event_id>, <nl>) AS content
FROM (
  SELECT g2, event_id,
         CASE WHEN g2 % 5 = 3 THEN concat('| ', method, ' | ', path, ' | ', note, ' |')
              WHEN g2 % 5 = 4 THEN concat('- ', <bq>, CASE WHEN event_id % 4 = 0 THEN 'the' ELSE method END, ' ', path, <bq>, ' ', note)
              ELSE concat('| ', <id event_id % 250>, ' | m', <id event_id % 6>, ' | ', method, ' | ', path, ' | ', note, ' |') END AS line
  FROM {calls} WHERE event_id % 7 <> 0) t
GROUP BY g2""",
    "usage_docs": """
SELECT concat('r', <id g2 % 3>) AS repo, concat('d', <id g2>) AS doc,
       concat('# usage', <nl>, '## 一、快速开始', <nl>, 'begin', <nl>, <join_lines block | event_id>, <nl>, '## 四、调用示例', <nl>, 'end', <nl>) AS content
FROM (
  SELECT g2, event_id,
         CASE WHEN event_id % 5 = 0 THEN concat('### ', method, ' ', path, <nl>, <nl>, '**功能描述**：', note, <nl>, '#### ', method, ' ', path, <nl>, '**认证**: no')
              WHEN event_id % 5 = 1 THEN concat('#### 接口', <id event_id>, ': [', method, '] ', path, <nl>, '**功能**: ', note)
              WHEN event_id % 5 = 2 THEN concat('### 接口', <id event_id>, ': ', method, ' ', path, <nl>, 'text', <nl>, '**认证要求**：no')
              WHEN event_id % 5 = 3 THEN concat('| ', method, ' | ', path, ' | ', note, ' |')
              ELSE concat('### [MCP工具] tool_', event_type, <nl>, 'plain ', note) END AS block
  FROM {calls}) t
GROUP BY g2""",
    "module_lists": """
SELECT concat('r', <id g2 % 3>) AS repo, concat('d', <id g2>) AS doc,
       concat('intro | a | b |', <nl>, <join_lines block | event_id>) AS content
FROM (
  SELECT g2, event_id,
         concat(CASE WHEN event_id % 64 = 0 THEN concat('### 2.', <id event_id % 9>, ' 核心', <id event_id % 3>, <nl>, '| 方法 | 路径 |', <nl>, '|---|---|', <nl>)
                     WHEN event_id % 64 = 40 THEN concat('### 辅助接口', <nl>)
                     WHEN event_id % 64 = 50 THEN concat('### 7 not a module', <nl>) ELSE '' END,
                '| ', method, ' | ', path, ' | ', note, ' |') AS block
  FROM {calls}) t
GROUP BY g2""",
    "common_docs": """
SELECT concat('r', <id g2 % 3>) AS repo, concat('d', <id g2>) AS doc,
       CASE g2 % 4
         WHEN 0 THEN concat('intro', <nl>, '## 一、快速开始', <nl>, body, <nl>, '## 三、错误处理', <nl>, 'codes', <nl>, '## 四、调用示例', <nl>, 'calls', <nl>)
         WHEN 1 THEN concat('## 一、快速开始', <nl>, body, <nl>, '## 二、按模块分类', <nl>, 'mods', <nl>, '## 四、调用示例', <nl>, 'calls', <nl>)
         WHEN 2 THEN concat('only text', <nl>, body)
         ELSE concat('## 三、错误处理', <nl>, body) END AS content
FROM (SELECT g2, <join_lines note | event_id> AS body FROM {calls} GROUP BY g2) t""",
    "module_docs": """
SELECT repo, module, concat('calls: ', <id count(*)>) AS content
FROM (
  SELECT concat('r', <id g2 % 3>) AS repo,
         CASE event_id % 8 WHEN 0 THEN '辅助接口' WHEN 1 THEN '核心业务接口' WHEN 2 THEN '系统管理接口' WHEN 3 THEN '会话管理接口'
                           WHEN 4 THEN 'zeta' WHEN 5 THEN '资源管理接口' WHEN 6 THEN 'alpha' ELSE '用户与认证接口' END AS module
  FROM {calls}) t
GROUP BY repo, module""",
    "state_log": """
SELECT repo, 'file' AS kind, relative_path AS key, CASE WHEN toxic = 1 THEN 'failed' ELSE 'completed' END AS value, doc_id * 10 + 1 AS seq
FROM {files} JOIN {labels} USING (doc_id)
UNION ALL
SELECT repo, 'file', relative_path, CASE WHEN doc_id % 2 = 0 THEN 'completed' ELSE 'failed' END, doc_id * 10 + 2
FROM {files} JOIN {labels} USING (doc_id) WHERE doc_id % 3 = 0
UNION ALL
SELECT repo, 'flag', CASE doc_id % 20 WHEN 0 THEN 'readme' WHEN 1 THEN 'reading_guide' WHEN 2 THEN 'api_doc' WHEN 3 THEN 'api_usage_doc' WHEN 4 THEN 'api_doc' ELSE 'readme' END,
       CASE WHEN doc_id % 3 = 0 THEN 'false' ELSE 'true' END, doc_id * 10 + 3
FROM {files} WHERE doc_id % 20 < 6
UNION ALL
SELECT repo, 'api_info', relative_path, concat('- [GET] /doc/', <id doc_id>), doc_id * 10 + 4 FROM {files} WHERE doc_id % 5 = 0
UNION ALL
SELECT repo, 'api_details', relative_path, concat('details ', <id doc_id>), doc_id * 10 + 5 FROM {files} WHERE doc_id % 5 = 0 AND (doc_id % 3 <> 0 OR doc_id % 4 = 2)
UNION ALL
SELECT repo, 'api_details', relative_path, CAST(NULL AS STRING), doc_id * 10 + 6 FROM {files} WHERE doc_id % 35 = 0""",
    "docs": """
SELECT repo, concat('docs/', relative_path, '.md') AS doc_path, content FROM {files} WHERE doc_id % 3 <> 1
UNION ALL
SELECT repo, CASE doc_id % 20 WHEN 0 THEN 'docs/README.md' WHEN 1 THEN 'docs/API_DOC.md' ELSE 'docs/API_USAGE.md' END, max(content)
FROM {files} WHERE doc_id % 20 < 3 GROUP BY repo, CASE doc_id % 20 WHEN 0 THEN 'docs/README.md' WHEN 1 THEN 'docs/API_DOC.md' ELSE 'docs/API_USAGE.md' END
UNION ALL
SELECT DISTINCT repo, concat('docs/', lang, '/', source, '/_dir_summary.md'), 'dir' FROM {files} WHERE doc_id % 9 = 0""",
    "page_links": """
SELECT concat('s', <id page_id % 5>) AS repo, concat('p', <id page_id>) AS source, <href html> AS targets FROM {pages}""",
    "event_lines": """
SELECT conv_id AS request_id, turn AS seq,
       CASE WHEN role = 'system' THEN 'event: ping'
            WHEN conv_id % 3 = 0 AND turn = 4 THEN 'data: [DONE]'
            WHEN conv_id % 7 = 1 AND turn = 1 THEN 'data: {broken'
            WHEN turn = 3 THEN concat('data: {', <dq>, 'type', <dq>, ':', <dq>, 'message_delta', <dq>, ',', <dq>, 'delta', <dq>, ':{', <dq>, 'stop_reason', <dq>, ':', <dq>, 'end_', role, <dq>, '}}')
            WHEN turn = 5 THEN concat('data: {', <dq>, 'type', <dq>, ':', <dq>, 'message_stop', <dq>, '}')
            ELSE concat('data: {', <dq>, 'type', <dq>, ':', <dq>, 'content_block_delta', <dq>, ',', <dq>, 'delta', <dq>, ':{', <dq>, 'type', <dq>, ':', <dq>, 'text_delta', <dq>, ',', <dq>, 'text', <dq>, ':', <dq>, clean, <dq>, '}}') END AS line
FROM (SELECT *, replace(replace(replace(replace(replace(text, chr(92), ''), chr(34), ''), chr(10), ' '), chr(13), ' '), chr(9), ' ') AS clean FROM {conversations}) t""",
    "chunks": """
SELECT conv_id AS request_id, turn AS seq,
       CASE WHEN role <> 'system' THEN text END AS content,
       CASE WHEN turn % 2 = 1 THEN concat('think ', <id turn>) END AS reasoning_content,
       CASE WHEN turn >= 3 THEN concat('stop', <id turn % 5>) ELSE '' END AS finish_reason
FROM {conversations}""",
    "messages": """
SELECT event_id,
       CASE WHEN event_id % 17 = 3 THEN concat('{', <dq>, 'type', <dq>, ':', <dq>, event_type)
            WHEN event_id % 19 = 4 THEN concat('[', <id event_id>, ']')
            WHEN event_id % 23 = 5 THEN concat('{', <dq>, 'data', <dq>, ':{', <dq>, 'task_id', <dq>, ':', <dq>, <id user_id>, <dq>, '}}')
            WHEN event_id % 29 = 6 THEN concat('{', <dq>, 'type', <dq>, ':', <dq>, event_type, <dq>, '}')
            ELSE concat('{', <dq>, 'type', <dq>, ':', <dq>, event_type, <dq>, ',', <dq>, 'timestamp', <dq>, ':', <dq>, '2024-01-01T00:00:00', <dq>, ',', <dq>, 'data', <dq>, ':{', <dq>, 'task_id', <dq>, ':', <dq>, <id user_id>, <dq>, ',', <dq>, 'current', <dq>, ':', <id event_id % 50>, '}}') END AS value
FROM {events}""",
    "trees": """
SELECT concat('t', <id doc_id>) AS repo,
       CASE WHEN doc_id % 11 = 2 THEN concat('{', <dq>, 'name', <dq>, ':', <dq>, source)
            WHEN doc_id % 13 = 3 THEN concat('{', <dq>, 'name', <dq>, ':', <dq>, source, <dq>, '}')
            ELSE concat('{', <dq>, 'name', <dq>, ':', <dq>, source, <dq>, ',', <dq>, 'node_type', <dq>, ':', <dq>, 'directory', <dq>, ',', <dq>, 'relative_path', <dq>, ':', <dq>, <dq>, ',', <dq>, 'depth', <dq>, ':0,', <dq>, 'children', <dq>, ':[',
                 '{', <dq>, 'name', <dq>, ':', <dq>, 'd', <id doc_id>, '.py', <dq>, ',', <dq>, 'node_type', <dq>, ':', <dq>, 'file', <dq>, ',', <dq>, 'relative_path', <dq>, ':', <dq>, 'd', <id doc_id>, '.py', <dq>, ',', <dq>, 'depth', <dq>, ':1,', <dq>, 'has_api', <dq>, ':true}]}') END AS json
FROM {documents}""",
    "progress": """
SELECT user_id AS task_id, ts, event_id AS seq, event_id % 4 AS depth,
       CASE WHEN event_id % 13 = 0 THEN 'directory' ELSE 'file' END AS node_type,
       concat('src/f', <id event_id % 40>, '.py') AS file_path,
       CASE WHEN event_id % 97 = 5 THEN 'analysis_error' WHEN event_id % 211 = 7 THEN 'task_cancelled'
            WHEN event_type = 'signup' THEN 'analysis_started' WHEN event_type = 'view' THEN 'analysis_file_started'
            WHEN event_type = 'click' THEN 'analysis_file_complete' WHEN event_type = 'error' THEN 'analysis_file_failed'
            WHEN event_id % 3 = 0 THEN 'analysis_complete' ELSE 'analysis_progress' END AS type,
       event_id % 50 AS current, (user_id % 5) * 25 AS total, concat('err ', <id event_id>) AS error
FROM {events}""",
}

_SPARK = {
    "bytes": r"octet_length(\1)", "div": "div",
    "join_lines": r"listagg(\1, '\\n') WITHIN GROUP (ORDER BY \2)",
    "href": "regexp_extract_all(\\1, 'href=\"([^\"]*)\"', 1)",
}
_DUCK = {
    "bytes": r"strlen(\1)", "div": "//",
    "join_lines": r"string_agg(\1, chr(10) ORDER BY \2)",
    "href": "regexp_extract_all(\\1, 'href=\"([^\"]*)\"', 1)",
}


def _spell(sql: str, words: dict[str, str]) -> str:
    sql = sql.replace("<div>", words["div"])
    for token, char in (("<nl>", "chr(10)"), ("<q>", "chr(39)"), ("<dq>", "chr(34)"), ("<bq>", "chr(96)")):
        sql = sql.replace(token, char)
    sql = re.sub(r"<id ([^<>]+)>", r"CAST(\1 AS STRING)", sql)
    sql = re.sub(r"<bytes (\w+)>", words["bytes"], sql)
    sql = re.sub(r"<href (\w+)>", words["href"], sql)
    return re.sub(r"<join_lines (\w+) \| (\w+)>", words["join_lines"], sql)


def _needs(name: str) -> list[str]:
    return sorted({n for n in re.findall(r"\{(\w+)\}", VIEWS[name]) if n in VIEWS or n in BASE})


def derive(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived view as a DataFrame, built only from what it needs."""
    if name in BASE:
        return table(spark, folder, name)
    return derive_from(spark, name, {n: derive(spark, folder, n) for n in _needs(name)})


def derive_from(spark: SparkSession, name: str, inputs: dict[str, DataFrame]) -> DataFrame:
    # braces other than table references are plain text
    sql = _spell(VIEWS[name], _SPARK).replace("{", "{{").replace("}", "}}")
    for n in inputs:
        sql = sql.replace("{{" + n + "}}", "{" + n + "}")
    return spark.sql(sql, **inputs)


def other_engine(name: str) -> str:
    """The same view for an engine that has the base tables under their names."""
    sql = _spell(VIEWS[name], _DUCK)
    for n in _needs(name):
        sql = sql.replace("{" + n + "}", n)
    return sql


def needed_views(names: list[str]) -> list[str]:
    """Views in an order in which each only uses earlier ones."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in BASE or name in out:
            return
        for n in _needs(name):
            add(n)
        out.append(name)

    for name in names:
        add(name)
    return out
