"""Where tables come from and are kept: pages, files, versioned mirrors."""
