"""Texts, limits and lists that results must agree with."""

# Sizes, in characters.
CHUNK_SIZE = 2000
EMBED_MAX_CHARS = 2000
EMBED_RETRY_MAX_CHARS = 1000

EMBED_MARKER = "\n[... truncated for embedding ...]"
EMBED_RETRY_MARKER = "\n[... truncated ...]"

# Search and scan defaults.
MIN_RESULTS = 1
DEFAULT_RESULTS = 5
PREVIEW_CHARS = 200
FILES_PER_BATCH = 1000
CHECKPOINT_EVERY = 500

# Default scan settings.
EXTENSIONS = [".java"]
EXCLUDE_PATTERNS = [
    "**/src/test/**",
    "**/target/**",
    "**/build/**",
    "**/node_modules/**",
    "**/.git/**",
    "**/src/main/resources/**",
    "**/*Test.java",
    "**/*Tests.java",
]

# Name prefixes of hand-written mapping methods.
POJO_PREFIXES = ["map", "convert", "transform", "to"]

# Context texts.
CODE_SECTION = "=== Relevant Code Files (Full Source Code) ===\n"
EXTRACTED_SECTION = "=== Extracted Mappings (On-Demand) ===\n"
STORED_SECTION = "=== Pre-Extracted Mappings (Summary) ===\n"
EMPTY_CONTEXT = "No relevant code or mappings found."

# Prompt texts.
SYSTEM_PROMPT = """You are an expert Java code understanding assistant specializing in MapStruct and POJO mappings. 
Your task is to analyze the provided FULL SOURCE CODE and answer questions with clear reasoning.

Guidelines:
1. Analyze the FULL CODE provided - you have the complete source code, not just summaries
2. Provide clear, detailed explanations based on the actual code
3. Reference specific lines, methods, and classes from the code
4. Explain the mapping logic and field transformations in detail
5. Identify where and how fields are used throughout the codebase
6. Be specific about source-to-destination mappings
7. If the code shows multiple related files, explain how they work together
8. If information is not available in the context, say so clearly"""

PROMPT_HEAD = "Based on the following FULL SOURCE CODE, answer this question: "
PROMPT_TAIL = """

Please provide:
1. A detailed explanation based on the actual code provided
2. Specific references to classes, methods, and fields in the code
3. How the mapping logic works in the context of the full codebase
4. Where and how the fields are used throughout the code
5. Any important patterns or relationships you notice in the code

Answer:"""

DESCRIBE_HEAD = "Analyze this Java code mapping and provide a clear description:\n\nCode:\n"
DESCRIBE_MIDDLE = "\n\nMapping Information:\n"
DESCRIBE_TAIL = "\n\nProvide a concise description of what this mapping does."

EXTRACT_HEAD = """Analyze this Java code and extract all field-level mappings between source and destination objects.

Code:
```java
"""
EXTRACT_TAIL = """
```

Extract:
1. MapStruct mappings (interfaces with @Mapper annotation)
2. POJO mappings (methods like mapXxx, convert, transform)
3. Field-level mappings (source field -> target field)
4. Any transformations or expressions

Return a JSON structure with:
- mapping_type: "mapstruct" or "pojo"
- source_type: source class name
- target_type: target class name
- method_name: method name (if applicable)
- field_mappings: [{"source_field": "...", "target_field": "...", "transformation": "..."}]

JSON:"""

NO_EMBEDDING_ERROR = "Could not generate embedding for question"
NO_ANSWER_ERROR = "Could not generate answer from LLM"
