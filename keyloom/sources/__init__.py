"""Facts from files: catalogs and source code."""
