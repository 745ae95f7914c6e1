"""proofloom.plans"""
