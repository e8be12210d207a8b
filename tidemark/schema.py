"""Record types and fixed values of the conversation-archive model."""

from __future__ import annotations

from pyspark.sql import types as T

#: The four sources, in the order in which counts list them.
SOURCES = ("cloud", "cowork", "cli-direct", "cli-desktop")
#: Later of these wins a tie when two records of a key are merged.
MERGE_ORDER = ("cowork", "cli-desktop", "cli-direct", "cloud")

TOKEN_TOTALS = T.StructType([T.StructField(n, T.LongType()) for n in ("input", "output", "cache_creation", "cache_read")])
COST_BREAKDOWN = T.StructType([T.StructField("model_id_used", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("input_usd", "output_usd", "cache_write_usd", "cache_read_usd")], T.StructField("note", T.StringType())])

#: One session; the key is (source, id).
SESSION = T.StructType(
    [
        *[T.StructField(n, T.StringType(), False) for n in ("id", "source", "raw_session_id")],
        *[T.StructField(n, T.LongType(), False) for n in ("started_at", "updated_at", "duration_ms")],
        *[T.StructField(n, T.StringType(), False) for n in ("title", "title_source", "cwd_kind")],
        T.StructField("user_turns", T.LongType(), False),
        *[T.StructField(n, T.StringType()) for n in ("preview", "model")],
        T.StructField("total_cost_usd", T.DoubleType()),
        T.StructField("assistant_turns", T.LongType()),
        T.StructField("models_used", T.ArrayType(T.StringType())),
        *[T.StructField(n, T.StringType()) for n in ("cwd", "project", "topic", "summary", "transcript_path", "manifest_path", "audit_path")],
        T.StructField("token_totals", TOKEN_TOTALS),
        T.StructField("cost_estimated_usd", T.DoubleType()),
        T.StructField("cost_is_estimate", T.BooleanType()),
        T.StructField("cost_breakdown", COST_BREAKDOWN),
        T.StructField("top_tools", T.MapType(T.StringType(), T.LongType())),
        T.StructField("source_mtime_ms", T.DoubleType()),
    ]
)
REQUIRED = tuple(f.name for f in SESSION.fields if not f.nullable)

BLOCK = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "text", "name")])
MESSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("uuid", "parent_message_uuid", "sender", "text")]
    + [T.StructField("content", T.ArrayType(BLOCK)), T.StructField("created_at", T.StringType()), T.StructField("updated_at", T.StringType())]
)
CONVERSATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("uuid", "name", "summary", "created_at", "updated_at")]
    + [T.StructField("account", T.StructType([T.StructField("uuid", T.StringType())])), T.StructField("chat_messages", T.ArrayType(MESSAGE))]
)
PROJECT = T.StructType([T.StructField(n, T.StringType()) for n in ("uuid", "name", "description", "prompt_template", "created_at", "updated_at")])

#: USD for a million tokens (input, output, cache write, cache read).
RATES = {
    "claude-opus-4-7": (15.0, 75.0, 18.75, 1.5),
    "claude-opus-4-6": (15.0, 75.0, 18.75, 1.5),
    "claude-opus-4-5": (15.0, 75.0, 18.75, 1.5),
    "claude-sonnet-4-6": (3.0, 15.0, 3.75, 0.3),
    "claude-sonnet-4-5": (3.0, 15.0, 3.75, 0.3),
    "claude-haiku-4-5": (1.0, 5.0, 1.25, 0.1),
    "claude-3-5-sonnet-20241022": (3.0, 15.0, 3.75, 0.3),
}
DEFAULT_MODEL = "claude-opus-4-6"

#: Project names that are ordinary words and never match.
PROJECT_DENYLIST = (
    "art", "design", "research", "notes", "ideas", "draft", "drafts", "demo", "test", "tests", "project", "projects",
    "script", "scripts", "chat", "main", "code", "work", "tasks", "todo", "personal", "general", "misc",
)
MIN_PROJECT_NAME = 5

#: Title patterns of projects, first match wins; placeholders, pass your own.
PROJECT_KEYWORDS = (("my-project-a", r"my[ -]?project[ -]?a"), ("my-project-b", r"my[ -]?project[ -]?b"), ("my-project-c", r"my[ -]?project[ -]?c"), ("my-blog", r"my[ -]?blog"))

#: Fixed value: titles and previews that ask whether a project is still alive.
PROBE = r"re-?evaluate|still (worth|viable|relevant)|revisit|check.?in|status of|profitability|feasibility|mvp|viable|worth (building|continuing|pursuing)|what (do you think|happened to)"

#: Words that never name a topic: the closed classes of English (grammar books list them), class by class, and some
#: plain verbs and adverbs. A list of one's own may be passed wherever this is a default, as labels depend on it.
STOPWORDS = (
    # articles, demonstratives, quantifiers
    "the", "this", "that", "these", "those", "each", "every", "either", "neither", "both", "all", "any", "some", "none", "few", "several", "many", "much", "more", "most", "less", "least", "other", "another", "such",
    # pronouns and possessives
    "you", "she", "they", "him", "her", "them", "its", "our", "your", "his", "their", "mine", "yours", "ours", "theirs", "myself", "itself", "themselves", "someone", "something", "anything", "nothing", "everything",
    # question words and relatives
    "who", "whom", "whose", "which", "what", "when", "where", "why", "how",
    # auxiliaries and modals
    "are", "was", "were", "been", "being", "has", "have", "had", "having", "does", "did", "doing", "can", "could", "may", "might", "must", "shall", "should", "will", "would", "not",
    # prepositions
    "about", "above", "across", "after", "against", "along", "among", "around", "before", "behind", "below", "between", "beyond", "during", "for", "from", "into", "off", "onto", "out", "over", "through", "toward", "under", "until", "upon", "via", "with", "within", "without",
    # conjunctions and connectives
    "and", "but", "nor", "yet", "because", "although", "though", "unless", "while", "since", "whether", "than", "then", "thus", "hence", "therefore", "however", "also", "too",
    # adverbs of degree, time and place
    "very", "quite", "rather", "just", "only", "even", "still", "already", "again", "always", "never", "often", "sometimes", "now", "here", "there", "well",
    # plain verbs
    "get", "got", "let", "make", "made", "say", "said", "see", "know", "think", "ask", "use", "using", "want", "need",
)

#: Types of transcript lines that the reader knows, and senders of messages.
KNOWN_LINE_TYPES = ("user", "assistant", "attachment", "progress", "file-history-snapshot", "queue-operation", "last-prompt", "ai-title")
KNOWN_SENDERS = ("human", "assistant")
UNTITLED = "Untitled session"
DAY_MS = 86_400_000
