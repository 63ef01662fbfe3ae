"""Row-local symbol kernel: no Spark imports."""

import sys

# The engines recurse a few frames per tree level and stop by their own depth limits (768 and 1024 levels), which lie above Python's default.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 30_000))
