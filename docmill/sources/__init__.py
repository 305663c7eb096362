"""Files as tables: decoded texts, and blocks of subtitles, word files and e-books."""
