"""Fixed values shared by operators and their SQL: word lists, prices, rules."""

# Price per 1,000 tokens (model, input, output); 'default' prices unknown models.
PRICES = [
    ("gpt-4", 0.03, 0.06),
    ("gpt-4-32k", 0.06, 0.12),
    ("gpt-4-turbo", 0.01, 0.03),
    ("gpt-4-turbo-preview", 0.01, 0.03),
    ("gpt-4.1", 0.01, 0.03),
    ("gpt-3.5-turbo", 0.001, 0.002),
    ("gpt-3.5-turbo-16k", 0.003, 0.004),
    ("claude-3-opus", 0.015, 0.075),
    ("claude-3-sonnet", 0.003, 0.015),
    ("claude-3-haiku", 0.00025, 0.00125),
    ("claude-2", 0.008, 0.024),
    ("claude-instant", 0.0008, 0.0024),
    ("gemini-pro", 0.001, 0.002),
    ("gemini-ultra", 0.01, 0.03),
    ("llama-2-70b", 0.0007, 0.0009),
    ("mixtral-8x7b", 0.0007, 0.0007),
    ("default", 0.001, 0.002),
]

# Name fragment to price row; the lowest priority number that matches wins, so
# special names come before the general ones that they contain.
MODEL_ALIASES = [
    (1, "gpt-4-turbo-preview", "gpt-4-turbo-preview"),
    (2, "gpt-4-turbo", "gpt-4-turbo"),
    (3, "gpt-4-32k", "gpt-4-32k"),
    (4, "gpt-4.1", "gpt-4.1"),
    (5, "gpt-4", "gpt-4"),
    (6, "gpt-3.5-turbo-16k", "gpt-3.5-turbo-16k"),
    (7, "gpt-3.5", "gpt-3.5-turbo"),
    (8, "gpt3.5", "gpt-3.5-turbo"),
    (9, "opus", "claude-3-opus"),
    (10, "sonnet", "claude-3-sonnet"),
    (11, "haiku", "claude-3-haiku"),
    (12, "claude-3", "claude-3-sonnet"),
    (13, "claude-instant", "claude-instant"),
    (14, "claude", "claude-2"),
    (15, "ultra", "gemini-ultra"),
    (16, "gemini", "gemini-pro"),
    (17, "llama", "llama-2-70b"),
    (18, "mixtral", "mixtral-8x7b"),
]

# Words with a happiness score from 1 to 9; scores from 4 to 6 count as neutral.
LEXICON = [
    ("the", 4.98), ("of", 4.94), ("and", 5.22), ("to", 4.98), ("a", 5.24), ("in", 5.5), ("is", 5.18),
    ("that", 4.94), ("it", 5.02), ("with", 5.72), ("for", 6.12), ("this", 6.34), ("are", 6.2), ("be", 6.6),
    ("was", 3.6), ("at", 3.9), ("from", 3.7), ("on", 6.56), ("by", 3.2), ("as", 3.4), ("thing", 6.3),
    ("only", 3.1), ("than", 3.8), ("then", 6.4), ("ones", 7.0), ("other", 6.1), ("hers", 7.4), ("stupid", 2.1),
    ("worthless", 1.9), ("love", 8.42), ("happy", 8.3), ("hate", 2.34), ("le", 6.5), ("la", 6.7), ("de", 3.5),
    ("que", 3.3), ("der", 6.2), ("die", 1.74), ("und", 6.3), ("nicht", 2.9), ("el", 6.1), ("los", 3.0),
]

# A second scorer with other values, for method agreement.
LEXICON_B = [
    ("the", 6.1), ("and", 6.4), ("with", 6.6), ("for", 6.5), ("this", 3.7), ("are", 6.8), ("be", 3.9), ("was", 3.2),
    ("from", 3.9), ("on", 6.2), ("by", 3.5), ("stupid", 1.8), ("worthless", 1.6), ("love", 8.6), ("hate", 2.0),
    ("le", 6.1), ("la", 6.4), ("de", 3.6), ("der", 3.7), ("die", 2.5), ("und", 6.6), ("nicht", 2.2), ("el", 6.4),
]

STOP_WORDS = ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "la", "de", "der", "die"]

NEGATORS = ["not", "no", "never", "nicht", "ne", "pas", "nunca"]

# Opposed word lists: pattern, one side, other side.
OPPOSED = [
    ("presence", ["here", "with", "this"], ["there", "from", "that"]),
    ("number", ["one", "only", "ones"], ["many", "are", "others"]),
    ("mood", ["love", "happy", "on"], ["hate", "stupid", "worthless"]),
]

# Sentence profile word lists.
EMOTION_WORDS = ["love", "hate", "happy", "stupid", "worthless", "shine"]
ACTION_WORDS = ["anoning", "ering", "heeding", "ending", "ing", "reed"]
OBJECT_WORDS = ["thing", "ones", "inst", "stone", "thest", "ined"]

# Misspellings of the basic grammar check.
MISSPELLINGS = ["teh", "adn", "yuo", "recieve", "occur", "separate"]

# Conflict levels from mild to severe and what to do about each.
SEVERITY = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_ACTIONS = [
    ("NONE", "pass"),
    ("LOW", "log"),
    ("MEDIUM", "rewrite"),
    ("HIGH", "rewrite and check"),
    ("CRITICAL", "block"),
]
