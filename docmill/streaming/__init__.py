"""The same operators over streams: windowed aggregates with watermarks, and folds that keep a key's state."""
