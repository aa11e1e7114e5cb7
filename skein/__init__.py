"""skein: chat-session logs as Spark DataFrames, from raw line files to a queryable archive."""
