"""Values that results depend on: patterns, word lists, labels and limits.

Patterns are in Java syntax; ``pystr.rx`` adds the flags that make ``\\w``,
``\\s``, ``.`` and ``$`` behave as in Python.
"""

# --- fixed values: scan defaults -------------------------------------------
IGNORE_PATTERNS = (
    "node_modules/**", "__pycache__/**", ".git/**", ".venv/**", "venv/**",
    "*.pyc", "*.pyo", "*.log", "*.tmp", ".DS_Store", "Thumbs.db",
    "*.egg-info/**", "dist/**", "build/**", ".idea/**", ".vscode/**",
)
INCLUDE_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs", ".cpp", ".c",
    ".h", ".cs", ".rb", ".php", ".swift", ".kt", ".scala", ".vue", ".svelte",
)
MAX_FILE_SIZE = 102400
NO_EXTENSION_LABEL = "(无扩展名)"

# --- fixed values: document names and text blocks ---------------------------
DIR_DOC_NAME = "_dir_summary.md"
FINAL_DOC_NAMES = {
    "readme": "README.md",
    "reading_guide": "READING_GUIDE.md",
    "api_doc": "API_DOC.md",
    "api_usage_doc": "API_USAGE.md",
}
DOC_SEPARATOR = "\n\n---\n\n"
EMPTY_DIR_TEXT = "此目录下没有可分析的子文档。"
DISPLAY_NAMES = (
    ("__init__.py", "[包初始化]"), ("setup.py", "[项目安装配置]"),
    ("main.py", "[程序入口]"), ("app.py", "[应用入口]"),
    ("index.js", "[模块入口]"), ("index.ts", "[模块入口]"),
    ("config", "[配置]"), ("utils", "[工具函数]"), ("helpers", "[辅助函数]"),
    ("constants", "[常量定义]"), ("types", "[类型定义]"),
    ("models", "[数据模型]"), ("services", "[服务层]"),
    ("controllers", "[控制器]"), ("routes", "[路由]"),
    ("middleware", "[中间件]"), ("tests", "[测试]"),
)
STATUS_MARKS = {
    "pending": "[ ]", "in_progress": "[~]", "completed": "[+]",
    "failed": "[x]", "skipped": "[-]",
}

# --- fixed values: import patterns -------------------------------------------
PY_IMPORT = r"^\s*import\s+([\w.]+)"
PY_FROM = r"^\s*from\s+([\w.]+)\s+import"
JS_FROM = r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]"""
JS_BARE = r"""import\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
TS_TYPE = r"""import\s+type\s+.*?\s+from\s+['"]([^'"]+)['"]"""
JAVA_IMPORT = r"^\s*import\s+([\w.]+)\s*;"
JAVA_EXTENDS = r"class\s+\w+\s+extends\s+(\w+)"
JAVA_IMPLEMENTS = r"class\s+\w+.*?implements\s+([\w,\s]+)"
GO_SINGLE = r'import\s+"([^"]+)"'
GO_BLOCK = r"import\s+\((.*?)\)"
GO_QUOTED = r'"([^"]+)"'

# --- fixed values: endpoint block tests --------------------------------------
API_BLOCK = r"<!--\s*API_START\s*-->(.*?)<!--\s*API_END\s*-->"
API_BLOCK_OPEN = r"<!--\s*API_START\s*-->(.*?)\z"
API_NO = ("包含API接口: 否", "包含API接口：否")
API_YES = ("包含API接口: 是", "包含API接口：是")
API_LIST_WORD = "接口列表"
API_BRACKET = r"\[[A-Za-z一-龥_]+\]\s*[/\w]"
API_LIST_ITEM = r"-\s+[A-Za-z一-龥_]+\s+[/\w]"
API_ROUTES = (r"/api/", r"/v\d+/", r"@\w+Mapping", r"@app\.\w+", r"@router\.\w+")

# --- fixed values: endpoint line and document grammars -------------------------
ENDPOINT_LINE = (
    r"^-\s*`?\[([^\]]+)\]\s*([^\s(`-]+(?:\([^)]*\)|(?:\s*\{[^}]+\}))?)`?"
    r"\s*(?:[-→]\s*(.*))?$"
)
# Same line, but hyphens may be part of the path (``strict=False``).
ENDPOINT_LINE_HYPHEN = (
    r"^-\s*`?\[([^\]]+)\]\s*([^\s(`]+(?:\([^)]*\)|(?:\s*\{[^}]+\}))?)`?"
    r"\s*(?:[-→]\s*(.*))?$"
)
OVERVIEW_ROW = r"^\|\s*(\d+)\s*\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|"
OVERVIEW_SIMPLE = r"^\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|"
OVERVIEW_LIST = r"-\s*`?([A-Za-z一-龥]+)\s+([^\s`]+)`?"
OVERVIEW_SKIP_METHOD = ("方法", "序号", "---", "")
OVERVIEW_SKIP_PATH = ("路径", "---", "")
OVERVIEW_SKIP_WORDS = ("the", "a", "an", "is", "are")
USAGE_HEADING = r"^(#{2,4})\s+(.+)$"
USAGE_META = r"\*\*功能(?:描述)?\*\*(?:：|:)|\*\*认证(?:要求)?\*\*(?:：|:)"
USAGE_LOOKAHEAD = 50
USAGE_BRACKET = r"^接口\d+\s*[:\s]\s*\[([^\]]+)\]\s*(.+)$"
USAGE_NUMBERED = r"^接口\d+\s*[:\s]\s*(GET|POST|PUT|DELETE|PATCH|MCP工具)\s+(.+)$"
USAGE_PLAIN = r"^([^\s:]+)[:\s]+(/[^\s]*|[a-zA-Z_][a-zA-Z0-9_]*)(?:\s|$)"
USAGE_TABLE = r"^\|\s*([^|]+)\s*\|\s*(/[^|]+)\s*\|"
USAGE_SKIP_METHOD = ("方法", "method", "---", "序号")
USAGE_SKIP_PATH = ("路径", "path", "---")
MODULE_NUMBERED = r"^###\s+\d+(?:\.\d+)+\s+(.+)$"
MODULE_PLAIN = r"^###\s+([^\d#].*)$"
MODULE_ROW = r"^\|\s*([^|]+)\s*\|\s*([^|]+)\s*\|"
MODULE_SKIP_METHOD = ("方法", "---", "")
MODULE_SKIP_PATH = ("路径", "---", "")
HEADING_VERB = r"^#{3,4}\s+(GET|POST|PUT|DELETE|PATCH)\s+(/[^\s]*)"
HEADING_TOOL = r"^#{3,4}\s+(?:\[)?MCP[^\]]*(?:\])?\s*[:\s]+(\w+)"

# --- fixed values: endpoint document text --------------------------------------
MODULE_SUFFIXES = ("server", "service", "tool", "client", "handler", "manager")
OTHER_MODULE = "其他"
OVERVIEW_HEAD = (
    "## 一、接口总览", "",
    "| 序号 | 模块 | 方法 | 路径 | 功能描述 | 认证 |",
    "|------|------|------|------|----------|------|",
)
OVERVIEW_EMPTY = "## 一、接口总览\n\n无API接口。\n"
OVERVIEW_TOTAL = "**接口总计：%d 个**"
AUTH_DEFAULT = "否"
GROUP_NAMES = {
    "apiserver": "API服务接口", "agentserver": "Agent服务接口",
    "mcpserver": "MCP服务接口", "mqtt_tool": "MQTT工具接口",
    "voice": "语音服务接口", "root": "根目录接口",
}
GROUP_SUFFIX = "接口"
MODULE_ORDER = (
    "核心业务接口", "会话管理接口", "资源管理接口",
    "用户与认证接口", "系统管理接口", "辅助接口",
)
QUICK_START = "## 一、快速开始"
QUICK_START_ENDS = ("## 二、", "## 三、", "## 四、")
QUICK_START_DEFAULT = "## 一、快速开始\n\n请参考各接口的请求示例进行调用。\n"
QUICK_START_MERGED_DEFAULT = "## 一、快速开始\n\n（快速开始内容待补充）"
DETAILS_HEAD = "\n\n## 二、接口详情\n"
ERRORS = "## 三、错误处理"
EXAMPLES = "## 四、调用示例"
ERRORS_DEFAULT = "\n\n## 三、错误处理\n\n请参考各接口文档中的错误响应说明。\n"
ERRORS_MERGED_DEFAULT = (
    "\n\n## 三、错误处理\n\n（错误处理内容待补充）"
    "\n\n\n## 四、调用示例\n\n（调用示例内容待补充）"
)
MODULE_SECTION = r"(##\s*二、按模块分类.*)"

# --- fixed values: stand-in text function and retry ------------------------------
STANDIN_FILE = "[模拟分析] 文件: %s\n代码行数: %d"
STANDIN_DIR = "[模拟总结] 目录: %s\n子文档数: %d"
STANDIN_PROJECT = "# %s\n\n[模拟README]\n\n路径: %s"
RETRY_BASE, RETRY_FACTOR, RETRY_CAP, RETRY_JITTER, MAX_RETRIES = 1.0, 2.0, 60.0, 0.25, 3
