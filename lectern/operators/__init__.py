"""DataFrame operators over lines, blocks, lists, tables and boxes."""
