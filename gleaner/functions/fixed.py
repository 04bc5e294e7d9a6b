"""Word lists, texts and formats that results depend on."""

# Words that are never a table or column name in a draft.
SQL_WORDS = [
    "select", "from", "where", "join", "inner", "left", "right", "outer",
    "on", "and", "or", "not", "null", "is", "as", "by", "order", "group",
    "having", "limit", "top", "distinct", "with", "case", "when", "then",
    "else", "end", "in", "between", "like", "exists", "all", "any",
    "sum", "count", "avg", "min", "max", "coalesce", "isnull", "getdate",
]

# Schema names that may qualify an object name.
SCHEMA_QUALIFIERS = ["dbo", "sys", "information_schema", "guest"]

# Phrases by which an answer declines a question.
DECLINE_PHRASES = [
    "cannot", "can't", "not in the schema", "don't have", "no table",
    "unable to find", "not found in", "does not exist", "no information",
    "not available in", "outside the scope", "none of the tables",
    "not contain", "no columns", "not included", "not part of",
    "not present in", "schema does not", "schema context does not",
    "no such table", "not covered", "not supported by", "beyond the scope",
    "unfortunately", "not provided in", "not reflected in", "don't see",
    "do not see", "i don't see", "i do not see", "does not include",
    "does not contain", "no mention", "there is no", "i apologize",
    "not include any", "no such", "isn't a table", "is not a table",
]

# Markers of a chat front end's own housekeeping prompts, and the reply they get.
TASK_MARKERS = [
    "### task:",
    "create a concise, 3-5 word title",
    "generate 1-3 broad tags",
]
TASK_REPLY = "Schema query"

# Placeholders of a rendered table document.
NO_DESCRIPTION = "<!-- TODO: no description on file -->"
NO_PRIMARY_KEY = "<!-- TODO: no primary key found -->"
NO_SUBJECT_AREA = "<!-- TODO: classify subject area -->"
NO_FOREIGN_KEYS = "*(none)*"
NAMING_NOTE = "*(add any table-level naming conventions here)*"

# Messages of the draft checks.
EMPTY_DRAFT = "Empty SQL input."
LIMIT_FOUND = (
    "LIMIT is not valid T-SQL (looks like Postgres/MySQL). "
    "Use TOP (n) or OFFSET ... FETCH NEXT ... ROWS ONLY."
)
DOUBLE_COLON_FOUND = (
    "'::' cast is not valid T-SQL (looks like Postgres). "
    "Use CAST(expr AS type) or CONVERT(type, expr)."
)
BACKTICK_FOUND = "SQL failed to tokenize as T-SQL (dialect/syntax error): backtick"
CHECK_FLAG = "\n\n---\n> ⚠️ Automated validation flagged this draft — review before running:\n"

# Reasons given with a score.
TRICK_WITH_SQL = "Generated SQL despite no valid schema match — should have declined"
TRICK_DECLINED = "Correctly declined to answer: schema gap acknowledged"
TRICK_SILENT = "No SQL but no explicit acknowledgment of schema gap"
PROSE_NONE = "No SQL generated and no expected table named in prose"

# Headings of the prompt's two parts, and the divider between documents.
CONTEXT_HEADING = "\n\n## Schema Context\n\n"
CONTEXT_DIVIDER = "\n\n---\n\n"
QUESTION_HEADING = "\n\n## Question\n"
