"""Tables: content, scratch space, tabular input, exports."""
