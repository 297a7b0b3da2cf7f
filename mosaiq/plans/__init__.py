"""Plan-level helpers: materialisation points and iterative graph plans."""
