"""Named queries over tables in a folder."""
