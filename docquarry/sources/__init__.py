"""Files: subtitles and entry XML, read and written by Spark."""
