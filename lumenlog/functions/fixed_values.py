"""Fixed values that must equal the original tool's for identical results.

FIXED VALUES -- stated as plain text, in their natural order. Everything here is
a default for a parameter; every operator accepts its own list instead.
Long word lists (English / CJK stop words) are *not* shipped: they are
parameters (see ``lumenlog.functions.text.load_word_list``); the defaults in
``DEFAULT_STOP_EN`` / ``DEFAULT_STOP_ZH_WORDS`` are short generic lists.
"""

# ---- FIXED VALUES: model price table (USD per million tokens), in priority order.
# (model key, input, output, cache write, cache read). Second row is the fallback.
PRICE_TABLE = [
    ("claude-opus-4-6", 15.00, 75.00, 18.75, 1.50),
    ("claude-sonnet-4-6", 3.00, 15.00, 3.75, 0.30),
    ("claude-haiku-4-5-20251001", 0.80, 4.00, 1.00, 0.08),
    ("claude-haiku-4-5", 0.80, 4.00, 1.00, 0.08),
]
FALLBACK_MODEL = "claude-sonnet-4-6"

# ---- FIXED VALUES: message kinds.
CONTENT_TYPES = ("user", "assistant", "system")
HEAD_LINES = 20

# ---- FIXED VALUES: decision-signal keywords (substring match, case-insensitive).
SIGNALS_ZH = [
    "决定", "决策", "选择", "方案", "结论", "确认", "不要", "改为",
    "换成", "触发条件", "下一步", "建议", "理由", "原因", "架构",
    "设计", "不建议", "放弃", "保留", "新增", "删除",
]
SIGNALS_EN = [
    "decided", "decision", "because", "reason", "instead",
    "approach", "conclusion", "next step", "recommend", "architecture",
    "design", "abandon", "keep", "add", "remove",
]

# ---- FIXED VALUES: session-weight signal patterns (regex alternations, case-insensitive).
DEV_SIGNAL_PATTERN = (
    "实现|开发|重写|重构|新增|创建|部署|迭代|优化|写入|编译|构建|"
    "修复|报错|失败|崩溃|"
    "implement|develop|refactor|build|deploy|create|write|migrate|ship|"
    "error|fail|crash|fix|debug"
)
STRATEGY_SIGNAL_PATTERN = (
    "可行性|产品化|路线图|愿景|商业模式|付费|变现|盈利|"
    "哲学|信仰|文明|宪法|法理|"
    "架构设计|系统设计|顶层设计|整体方案|"
    "研究.*对比|对比.*研究|深入.*分析|"
    "vision|roadmap|monetiz|business model|philosophy"
)
WEIGHT_VALUES = {"ops": 1, "dev": 2, "strategy": 3}

# ---- FIXED VALUES: focus noise prefixes (message skipped when it starts with one).
FOCUS_NOISE_PREFIXES = [
    "<local-command", "<system-reminder", "<task-notification",
    "Updated task", "The file", "File created", "Found ",
    "No files", "Showing ", "Tool loaded", "Usage: ",
    "/Users/", "~/", "---", "```",
]
FOCUS_MIN_LEN = 5
FOCUS_MAX_SLASH_RATIO = 0.05

# ---- FIXED VALUES: CJK stop characters removed from CJK runs before n-grams.
STOP_ZH_CHARS = "的了是在我他你这那和也就都而及与着被地得到说要会没有人上下来去对不"

# ---- FIXED VALUES: digest tool-output prefixes (user text starting so is not conversational).
DIGEST_TOOL_PREFIXES = [
    "The file ", "File created", "Found ", "No files found",
    "Usage: ", "Error:", "[", "{",
]
DIGEST_MIN_USER = 15
DIGEST_MIN_ASSISTANT = 30

# ---- FIXED VALUES: compile topic noise prefixes and markers.
TOPIC_NOISE_PREFIXES = [
    "<local-command", "<command-", "{", "[", "#", "---", "infra:",
    "Exit code", "Web search", "Found ", "File content",
    "Protocol error", "hostkeys_", "Command running",
    "claude-safe", "100%", "70 100%",
]
TOPIC_NOISE_CONTAINS = ["xfer#", "Session Handoff", "工作规范"]

# ---- FIXED VALUES: file-change detection in assistant text.
FILE_CHANGE_TOOLS = ["Write", "Edit", "NotebookEdit"]
FILE_CHANGE_PATTERN = r"""(/Users/[^\s"']+\.(?:md|py|json|ts|js|html|css|yaml|yml|toml|sh))"""

# ---- FIXED VALUES: tool events.
FILE_TOOLS = ["Read", "Edit", "Write", "NotebookEdit"]
COMMAND_MAX_LEN = 120
SECRET_FLAG_PATTERN = r"((?:--?(?:token|key|secret|password|auth|bearer|api[_-]?key)\s+))[^\s]+"

# ---- FIXED VALUES: concept status thresholds and document markers.
STATUS_MATURE_MIN = 5
STATUS_GROWING_MIN = 3
PROTECTED_DAY_MARKERS = ["source: archaeological-recovery", "source: merged"]

# ---- Short generic defaults for the long stop-word parameters (not the original lists).
DEFAULT_STOP_EN = [
    "the", "and", "for", "are", "but", "not", "you", "with", "this", "that",
    "they", "have", "from", "been", "will", "more", "when", "than", "then",
    "some", "what", "into", "just", "like", "also", "here", "each", "would",
    "could", "should", "there", "about", "which", "after", "before", "where",
    "these", "those", "their", "them", "were", "does", "only", "very",
]
DEFAULT_STOP_ZH_WORDS = ["这个", "那个", "一个", "没有", "可以", "什么", "我们", "因为", "所以", "但是"]

# ---- FIXED VALUES: headings that mark sections in users' project notes (parsed, not written).
STATUS_HEADINGS = ["当前状态", "Current Status", "Project Status"]
POSITIONING_HEADINGS = ["项目定位", "Project Overview", "About"]
COMPANION_NOTE = "CONTEXT.md"
SUMMARY_JOINER = "；"

# ---- Document markers of this library (written and detected by it; parameters, own wording).
TRAIL_HEADING = "Evolution trail"
STUB_MARKER = "definition pending"
NOTE_SOURCE_TAG = "[CLAUDE.md]"
NOTE_DEFAULT_SUMMARY = "Project file updated"
