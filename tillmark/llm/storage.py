"""Tables an operator writes down in the cluster's shared folder."""

from tillmark.sources.scratch import run_folder, shared_dir, stored

__all__ = ["run_folder", "shared_dir", "stored"]
