"""Part of quillspark; see README.md."""
