"""Intermediate tables, see ``tallyloom.functions.scratch``, where the core has them too."""

from tallyloom.functions.scratch import LOCAL_FOLDER, clear, folder, materialize, new_path, text_batches, unused

__all__ = ["LOCAL_FOLDER", "clear", "folder", "materialize", "new_path", "text_batches", "unused"]
