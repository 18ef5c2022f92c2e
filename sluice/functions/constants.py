"""Fixed values of the data contracts."""

# File extension -> language.
EXTENSIONS = {
    "py": "Python", "pyw": "Python", "java": "Java", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "c": "C", "h": "C",
    "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++", "hxx": "C++", "cs": "C#", "ts": "TypeScript", "tsx": "TypeScript",
    "rb": "Ruby", "go": "Go", "rs": "Rust", "php": "PHP", "swift": "Swift", "kt": "Kotlin", "kts": "Kotlin", "m": "Objective-C",
    "mm": "Objective-C++", "scala": "Scala", "sh": "Shell", "bash": "Shell", "zsh": "Shell", "ps1": "PowerShell", "sql": "SQL", "r": "R",
    "jl": "Julia", "lua": "Lua", "dart": "Dart", "json": "JSON", "yml": "YAML", "yaml": "YAML", "toml": "TOML", "ini": "INI",
    "md": "Markdown", "rst": "reStructuredText", "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "SCSS", "sass": "Sass",
    "less": "Less", "xml": "XML", "vue": "Vue", "svelte": "Svelte", "ipynb": "Jupyter Notebook",
}

# The topic groups and the confidence from which an assignment counts.
TOPIC_GROUPS = ["AI, Data, and Science", "Backend, APIs, and Security", "Distributed and Embedded Systems", "Graphics", "Web and Mobile"]
TOPIC_CONFIDENCE = 0.7

# Labels of the points in time after a merge, and their days.
TIMEPOINTS = {"0d": 0, "+3d": 3, "+7d": 7, "+31d": 31, "+61d": 61}

# Star counts up to which a repository is of low and of medium popularity.
LOW_STARS, MEDIUM_STARS = 0, 18

# Languages that characteristics are told apart by.
CHARACTERISTIC_LANGUAGES = ["python", "javascript", "java", "c++"]

# The relationship label that is no refactoring.
NO_REFACTORING = ["same"]

# Agent -> (authors, branch prefixes, markers in body or comments).
AGENT_RULES = {
    "devin": (["devin-ai-integration[bot]"], ["devin/"], []),
    "jules": (["google-labs-jules[bot]"], [], []),
    "codex": ([], ["codex/"], []),
    "claude": (["claude[bot]"], ["claude/"], ["Co-Authored-By: Claude", "Generated with Claude Code"]),
    "copilot": ([], ["copilot/"], []),
    "cursor": ([], ["cursor/"], []),
    "junie": (["jetbrains-junie[bot]", "junie-eap[bot]"], [], []),
    "codegen": (["codegen-sh"], [], ["About Codegen"]),
    "cosine": ([], ["cosine/"], []),
    "openhands": (["openhands", "openhands-agent"], ["openhands"], ["Co-authored-by: openhands", "Automatic fix generated by OpenHands"]),
}
