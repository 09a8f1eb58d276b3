"""Column functions: words and text, ids, cue times, tagged values."""
